"""Performance documents: instructions of all kinds read from nested XML into typed tables, and written back.

A document has one or more performances; each has maps of dated instructions, style switches among them,
and definitions in its header, for all parts together and for single parts. One document is one row
while it is read or written; a corpus is as many files or rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tactuslab.model import INSTRUCTIONS, META, NOTES, PEDALS, PPQ, State
from tactuslab.sources.msm import _attribute, _quoted

# Names of the document format.
#: By kind: the map that instructions stand in, and their element.
MAPS = {
    "tempo": ("tempoMap", "tempo"),
    "dynamics": ("dynamicsMap", "dynamics"),
    "ornament": ("ornamentationMap", "ornament"),
    "rubato": ("rubatoMap", "rubato"),
    "articulation": ("articulationMap", "articulation"),
    "accentuation_pattern": ("metricalAccentuationMap", "accentuationPattern"),
    "movement": ("movementMap", "movement"),
    "asynchrony": ("asynchronyMap", "asynchrony"),
}
#: Attributes that are named otherwise than columns.
ATTRIBUTES = {
    "beat_length": "beatLength", "transition_from": "transition.from", "transition_to": "transition.to", "mean_tempo_at": "meanTempoAt", "name_ref": "name.ref", "note_order": "note.order",
    "frame_start": "frame.start", "frame_length": "frameLength", "time_unit": "time.unit", "noteoff_shift": "noteoff.shift", "late_start": "lateStart", "early_end": "earlyEnd",
    "rel_dur": "relativeDuration", "rel_vel": "relativeVelocity", "abs_dur": "absoluteDuration", "abs_dur_change": "absoluteDurationChange", "milliseconds_offset": "milliseconds.offset",
    "default_articulation": "defaultArticulation",
}
#: Map of the style switches of each kind, and the header's element that holds the definitions of each type.
STYLE_MAPS = {"ornament": "ornamentationMap", "articulation": "articulationMap", "accentuationPattern": "metricalAccentuationMap"}
DEFINITIONS = {"ornamentDef": "ornamentationStyles", "articulationDef": "articulationStyles", "accentuationPatternDef": "metricalAccentuationStyles"}
STYLE = "performance_style"

_SPREAD = ("frame_start", "frame_length", "intensity", "noteoff_shift", "time_unit")
_GRADIENT = ("transition_from", "transition_to")
_ASPECTS = ("rel_dur", "rel_vel", "abs_dur", "abs_dur_change")
_ACCENT = ("beat", "value", "transition_from", "transition_to")
_TEXTS = {"noteoff_shift", "time_unit"}
BODIES = {
    "ornamentDef": ", ".join(f"{c} {'string' if c in _TEXTS else 'double'}" for c in (*_SPREAD, *_GRADIENT)),
    "articulationDef": ", ".join(f"{c} double" for c in _ASPECTS),
    "accentuationPatternDef": f"children array<struct<{','.join(f'{c}:double' for c in _ACCENT)}>>, length double",
}


def _name(column: str) -> str:
    return ATTRIBUTES.get(column, column)


def _columns(kind: str) -> list[tuple[str, str]]:
    return [tuple(c.rsplit(" ", 1)) for c in INSTRUCTIONS[kind].split(", ")]


def _fields(pairs: list[tuple[str, str]]) -> str:
    """Attributes as fields of a struct; lists are texts there."""
    return ",".join(f"`_{_name(c)}`:{'string' if t.startswith('array') else t}" for c, t in pairs)


def _dated_type() -> str:
    head = "`_xml:id`:string,`_date`:double,`_corresp`:string"
    style = "style:array<struct<`_xml:id`:string,`_date`:double,`_name.ref`:string,`_defaultArticulation`:string>>"
    maps = [f"{outer}:struct<{inner}:array<struct<{head},{_fields(_columns(kind))}>>{',' + style if outer in STYLE_MAPS.values() else ''}>" for kind, (outer, inner) in MAPS.items()]
    return f"struct<{','.join(maps)}>"


def _header_type() -> str:
    doubles = lambda names: _fields([(c, "string" if c in _TEXTS else "double") for c in names])
    defs = {
        "ornamentDef": f"`_name`:string,temporalSpread:struct<{doubles(_SPREAD)}>,dynamicsGradient:struct<{doubles(_GRADIENT)}>",
        "articulationDef": f"`_name`:string,{doubles(_ASPECTS)}",
        "accentuationPatternDef": f"`_name`:string,`_length`:double,accentuation:array<struct<{doubles(_ACCENT)}>>",
    }
    return f"struct<{','.join(f'{DEFINITIONS[d]}:struct<styleDef:array<struct<{d}:array<struct<{inner}>>>>>' for d, inner in defs.items())}>"


_TEXT = "struct<`_number`:string,`_VALUE`:string>"
_APP = "struct<`_name`:string,`_version`:string,`_url`:string>"
_METADATA = f"struct<author:array<{_TEXT}>,comment:array<{_TEXT}>,relatedResources:struct<resource:array<struct<`_uri`:string,`_type`:string>>>,appInfo:array<{_APP}>>"


def _schema() -> str:
    body = f"header:{_header_type()},dated:{_dated_type()}"
    return f"metadata {_METADATA}, performance array<struct<`_name`:string,`global`:struct<{body}>,part:array<struct<`_number`:int,{body}>>>>"


def _own(s: Column, c: str) -> Column:
    return s.getField(f"_{_name(c)}")


def read(spark: SparkSession, path: str, multi_line: bool = True) -> State:
    """All documents under path as tables; notes, pedals and meta are empty, and each table is there.

    A file is one document, or with multi_line off, one in each line. What is no document gives no rows.
    perf_id is the performance's name if that is a number, else a hash of the file's name and it. Instructions
    without an id get none; corresp becomes provenance. Order within a document isn't kept beyond dates.
    """
    text = spark.read.text(path, wholetext=multi_line)
    rows = text.select(F.from_xml("value", _schema(), {"attributePrefix": "_"}).alias("d"), F.input_file_name().alias("_file")).select("d.*", "_file")
    name = F.col("p").getField("_name")
    rows = rows.select("metadata", F.col("_file").alias("f"), F.explode("performance").alias("p"))
    rows = rows.withColumn("perf_id", F.coalesce(name.try_cast("long"), F.xxhash64("f", name)))
    none = F.lit(None).cast("int")
    part = lambda p: F.struct((p["_number"] - 1).cast("int").alias("scope"), p["header"].alias("header"), p["dated"].alias("dated"))
    general = F.struct(none.alias("scope"), F.col("p.global.header").alias("header"), F.col("p.global.dated").alias("dated"))
    scopes = rows.select("perf_id", F.explode(F.concat(F.array(general), F.coalesce(F.transform("p.part", part), F.array().cast("array<struct<scope:int,header:" + _header_type() + ",dated:" + _dated_type() + ">>")))).alias("s"))
    scopes = scopes.select("perf_id", "s.scope", "s.header", "s.dated")

    tables, provenance = {}, []
    for kind, (outer, inner) in MAPS.items():
        x = scopes.select("perf_id", "scope", F.explode(F.col("dated").getField(outer).getField(inner)).alias("x"))
        value = lambda c, t: F.split(_own(F.col("x"), c), " ").alias(c) if t.startswith("array") else _own(F.col("x"), c).alias(c)
        tables[kind] = x.select("perf_id", "scope", F.col("x").getField("_xml:id").alias("id"), F.col("x").getField("_date").alias("date"), *[value(c, t) for c, t in _columns(kind)])
        said = F.col("x").getField("_corresp")
        provenance.append(x.where(said.isNotNull()).select("perf_id", F.lit(None).cast("string").alias("transformer_id"), F.col("x").getField("_xml:id").alias("instruction_id"), F.split(said, " ").alias("corresp")))
    tables["provenance"] = reduce(DataFrame.unionByName, provenance)

    styles = []
    for kind, outer in STYLE_MAPS.items():
        s = scopes.select("perf_id", "scope", F.explode(F.col("dated").getField(outer).getField("style")).alias("x"))
        get = F.col("x").getField
        styles.append(s.select("perf_id", "scope", F.lit(kind).alias("map_type"), get("_xml:id").alias("id"), get("_date").alias("date"), get("_name.ref").alias("name_ref"), get("_defaultArticulation").alias("default_articulation")))
    tables["styles"] = reduce(DataFrame.unionByName, styles)

    fields = lambda s, names: [_own(s, c).alias(c) for c in names]
    body = {
        "ornamentDef": lambda x: F.struct(*fields(x["temporalSpread"], _SPREAD), *fields(x["dynamicsGradient"], _GRADIENT)),
        "articulationDef": lambda x: F.struct(*fields(x, _ASPECTS)),
        "accentuationPatternDef": lambda x: F.struct(F.transform(x["accentuation"], lambda a: F.struct(*fields(a, _ACCENT))).alias("children"), x["_length"].alias("length")),
    }
    defs = []
    for kind, outer in DEFINITIONS.items():
        found = scopes.select("perf_id", "scope", F.explode(F.col("header").getField(outer)["styleDef"]).alias("s")).select("perf_id", "scope", F.explode(F.col("s").getField(kind)).alias("x"))
        defs.append(found.select("perf_id", "scope", F.lit(kind).alias("def_type"), F.col("x").getField("_name").alias("name"), F.to_json(body[kind](F.col("x"))).alias("body")))
    tables["definitions"] = reduce(DataFrame.unionByName, defs)
    tables["metadata"] = _read_metadata(rows)
    empty = lambda kind: spark.createDataFrame([], kind)
    return State(empty(NOTES), empty(PEDALS), empty(META), tables)


def _read_metadata(rows: DataFrame) -> DataFrame:
    """Authors, comments, resources and programs in this order; a text without attributes is a JSON string, all else an object."""
    plain = lambda x: F.substring(F.to_json(F.array(x)), F.lit(2), F.length(F.to_json(F.array(x))) - 2)
    text = lambda x: F.when(x["_number"].isNull(), plain(x["_VALUE"])).otherwise(F.to_json(F.struct(x["_number"].try_cast("long").alias("number"), x["_VALUE"].alias("text"))))
    some = lambda *names: lambda x: F.to_json(F.struct(*[x[f"_{n}"].alias(n) for n in names]))
    kinds = (("author", "metadata.author", text), ("comment", "metadata.comment", text), ("relatedResource", "metadata.relatedResources.resource", some("type", "uri")), ("appInfo", "metadata.appInfo", some("name", "url", "version")))
    of = lambda kind, form: lambda x: F.struct(F.lit(kind).alias("kind"), form(x).alias("body"))
    found = F.concat(*[F.coalesce(F.transform(F.col(at), of(kind, form)), F.array().cast("array<struct<kind:string,body:string>>")) for kind, at, form in kinds])
    return rows.select("perf_id", F.posexplode(found).alias("pos", "x")).select("perf_id", "pos", "x.kind", "x.body")


def _element(name: str, attributes: list[tuple[str, Column]], content: Column | None = None) -> Column:
    opened = [F.lit(f"<{name}"), *[_attribute(a, v) for a, v in attributes]]
    return F.concat(*opened, F.lit("/>")) if content is None else F.concat(*opened, F.lit(">"), content, F.lit(f"</{name}>"))


def _joined(rows: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Texts x of rows of the same keys, in order, as one."""
    own = F.array_sort(F.collect_list(F.struct(*order, "x")))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(own, lambda r: r.x), "").alias(out))


def _definition(kind: str) -> Column:
    b = lambda c: F.col("b").getField(c)
    some = lambda names: [(_name(c), b(c)) for c in names]
    head = [("name", F.col("name"))]
    if kind == "articulationDef":
        return _element(kind, head + some(_ASPECTS))
    if kind == "accentuationPatternDef":
        accents = F.transform(b("children"), lambda a: _element("accentuation", [(_name(c), a[c]) for c in _ACCENT]))
        return _element(kind, [*head, ("length", b("length"))], F.coalesce(F.array_join(accents, ""), F.lit("")))
    present = lambda names: reduce(lambda x, y: x | y, [b(c).isNotNull() for c in names])
    spread = F.when(present(_SPREAD), _element("temporalSpread", some(_SPREAD))).otherwise("")
    gradient = F.when(present(_GRADIENT), _element("dynamicsGradient", some(_GRADIENT))).otherwise("")
    return _element(kind, head, F.concat(spread, gradient))


def _metadata(table: DataFrame) -> DataFrame:
    """perf_id and metadata: its elements, resources together at the first one's place."""
    get = lambda key: F.get_json_object("body", f"$.{key}")
    plain = F.get_json_object(F.concat(F.lit('{"x":'), "body", F.lit("}")), "$.x")  # a JSON string without its quotes
    is_text = F.substring("body", 1, 1) == '"'
    content = _quoted(F.coalesce(F.when(is_text, plain).otherwise(get("text")), F.lit("")))
    numbered = lambda name: F.when(is_text, _element(name, [], content)).otherwise(_element(name, [("number", get("number"))], content))
    one = (
        F.when(F.col("kind") == "author", numbered("author")).when(F.col("kind") == "comment", numbered("comment"))
        .when(F.col("kind") == "relatedResource", _element("resource", [("uri", get("uri")), ("type", get("type"))])).otherwise(_element("appInfo", [("name", get("name")), ("version", get("version")), ("url", get("url"))]))
    )
    is_resource = F.col("kind") == "relatedResource"
    rows = table.select("perf_id", is_resource.alias("_r"), F.when(is_resource, 0).otherwise(F.col("pos")).alias("_g"), "pos", one.alias("x"))
    groups = rows.groupBy("perf_id", "_r", "_g").agg(F.min("pos").alias("pos"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda r: r.x), "").alias("x"))
    groups = groups.withColumn("x", F.when(F.col("_r"), _element("relatedResources", [], F.col("x"))).otherwise(F.col("x")))
    return _joined(groups, ["perf_id"], ["pos"], "metadata")


def to_xml(state: State, performances: DataFrame | None = None) -> DataFrame:
    """perf_id and xml: the document of each performance of state.meta, or of a table with perf_id.

    Maps come in a fixed order, each one's instructions and style switches by date, then kind and id. What an
    instruction refers to (provenance) is its corresp. Null attributes are left out; parts follow by number.
    """
    said = state.table("provenance").where("size(corresp) > 0").groupBy("perf_id", F.col("instruction_id").alias("id"))
    said = said.agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("corresp")))), " ").alias("_said"))
    lines = []
    for k, (kind, (outer, inner)) in enumerate(MAPS.items()):
        if kind not in state.tables:
            continue
        rows = state.table(kind).join(said, ["perf_id", "id"], "left")
        value = lambda c, t: F.array_join(c, " ") if t.startswith("array") else F.col(c)
        x = _element(inner, [("xml:id", F.col("id")), ("date", F.col("date")), *[(_name(c), value(c, t)) for c, t in _columns(kind)], ("corresp", F.col("_said"))])
        lines.append(rows.select("perf_id", "scope", F.lit(k).alias("_map"), F.lit(outer).alias("_outer"), "date", F.lit(1).alias("_second"), "id", x.alias("x")))
    outers = [m for m, _ in MAPS.values()]
    styles = state.table("styles")
    x = _element("style", [("xml:id", F.col("id")), ("date", F.col("date")), ("name.ref", F.col("name_ref")), ("defaultArticulation", F.col("default_articulation"))])
    for kind, outer in STYLE_MAPS.items():
        lines.append(styles.where(F.col("map_type") == kind).select("perf_id", "scope", F.lit(outers.index(outer)).alias("_map"), F.lit(outer).alias("_outer"), "date", F.lit(0).alias("_second"), "id", x.alias("x")))
    maps = _joined(reduce(DataFrame.unionByName, lines), ["perf_id", "scope", "_map", "_outer"], ["date", "_second", "id"], "body")
    maps = maps.withColumn("x", F.concat(F.lit("<"), "_outer", F.lit(">"), "body", F.lit("</"), "_outer", F.lit(">")))
    dated = _joined(maps, ["perf_id", "scope"], ["_map"], "dated")

    heads = []
    for k, (kind, outer) in enumerate(DEFINITIONS.items()):
        own = state.table("definitions").where(F.col("def_type") == kind).withColumn("b", F.from_json("body", BODIES[kind]))
        own = _joined(own.select("perf_id", "scope", "name", _definition(kind).alias("x")), ["perf_id", "scope"], ["name"], "body")
        heads.append(own.select("perf_id", "scope", F.lit(k).alias("_map"), _element(outer, [], _element("styleDef", [("name", F.lit(STYLE))], F.col("body"))).alias("x")))
    header = _joined(reduce(DataFrame.unionByName, heads), ["perf_id", "scope"], ["_map"], "header")

    scopes = dated.withColumn("header", F.lit(None).cast("string")).unionByName(header.withColumn("dated", F.lit(None).cast("string")))
    scopes = scopes.groupBy("perf_id", "scope").agg(*[F.coalesce(F.max(c), F.lit("")).alias(c) for c in ("header", "dated")])
    inner = F.concat(F.lit("<header>"), "header", F.lit("</header><dated>"), "dated", F.lit("</dated>"))
    number = F.col("scope") + 1
    x = F.when(F.col("scope").isNull(), F.concat(F.lit("<global>"), inner, F.lit("</global>"))).otherwise(_element("part", [("name", F.lit("")), ("number", number), ("midi.channel", F.col("scope")), ("midi.port", F.lit(0))], inner))
    bodies = _joined(scopes.select("perf_id", F.coalesce("scope", F.lit(-1)).alias("_at"), x.alias("x")), ["perf_id"], ["_at"], "body")
    out = (performances or state.meta).select("perf_id").distinct().join(bodies, "perf_id", "left").join(_metadata(state.table("metadata")), "perf_id", "left")
    meta = F.coalesce(F.concat(F.lit("<metadata>"), "metadata", F.lit("</metadata>")), F.lit(""))
    performance = _element("performance", [("name", F.col("perf_id")), ("pulsesPerQuarter", F.lit(PPQ))], F.coalesce("body", F.lit("")))
    return out.select("perf_id", F.concat(F.lit('<mpm xmlns="http://www.cemfi.de/mpm/ns/1.0">'), meta, performance, F.lit("</mpm>")).alias("xml"))
