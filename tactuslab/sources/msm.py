"""Musical score files: notes and pedals read from XML, and written to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tactuslab.model import PPQ

_NOTE = (
    "`_xml:id` string, _date double, _pitchname string, _octave int, _accidentals double, `_midi.pitch` double, _duration double, `_midi.onset` double, "
    "`_midi.duration` double, `_midi.velocity` double"
)
_SCORE = f"struct<score:struct<note:array<struct<{_NOTE.replace(' string', ': string').replace(' double', ': double').replace(' int,', ': int,')}>>>>"

_PEDALS = "struct<pedal:array<struct<`_xml:id`:string,_type:string,_date:double,`_date.end`:double,`_midi.onset`:double,`_midi.duration`:double,_source:string>>>"


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """Notes of all files under path; perf_id is a hash of the file's name.

    A note without an onset at a file's first date has the onset 0: writers leave zeros out.
    """
    kind = f"`_number` int, `_name` string, dated {_SCORE}"
    rows = spark.read.format("xml").option("rowTag", "part").option("attributePrefix", "_").schema(kind).load(path)
    return _notes(rows.select(F.xxhash64(F.input_file_name()).alias("perf_id"), F.col("_number").alias("part"), F.posexplode("dated.score.note").alias("pos", "n")))


def notes_of(documents: DataFrame) -> DataFrame:
    """read_notes of documents (perf_id, xml) in a table, each with its own perf_id: a corpus needn't be a file for each."""
    kind = f"part array<struct<_number:int,_name:string,dated:{_SCORE}>>"
    rows = documents.select("perf_id", F.explode(F.from_xml("xml", F.lit(kind), {"attributePrefix": "_"})["part"]).alias("p"))
    return _notes(rows.select("perf_id", F.col("p._number").alias("part"), F.posexplode("p.dated.score.note").alias("pos", "n")))


def _notes(rows: DataFrame) -> DataFrame:
    n = lambda c: F.col(f"n.`{c}`")
    rows = rows.select(
        "perf_id", n("_xml:id").alias("note_id"), "part", "pos", n("_date").cast("long").alias("date"), n("_duration").cast("long").alias("duration"), n("_pitchname").alias("pitchname"),
        n("_accidentals").cast("int").alias("accidentals"), n("_octave").alias("octave"), n("_midi.pitch").cast("int").alias("midi_pitch"), n("_midi.onset").alias("onset"),
        n("_midi.duration").alias("midi_duration"), n("_midi.velocity").alias("velocity"),
    )
    w = Window.partitionBy("perf_id")
    first = F.col("date") == F.min("date").over(w)
    rows = rows.withColumn("_first", first).withColumn("onset", F.when(F.col("_first"), F.coalesce("onset", F.lit(0.0))).otherwise(F.col("onset")))
    return rows.withColumn("seq", F.row_number().over(w.orderBy("date", "part", "pos")).cast("long")).drop("_first", "pos")


def read_pedals(spark: SparkSession, path: str) -> DataFrame:
    """Pedals of all files under path, in the order of each file."""
    rows = spark.read.format("xml").option("rowTag", "global").option("attributePrefix", "_").schema(f"pedalMap {_PEDALS}").load(path)
    return _pedals(rows.select(F.xxhash64(F.input_file_name()).alias("perf_id"), F.posexplode("pedalMap.pedal").alias("seq", "p")))


def pedals_of(documents: DataFrame) -> DataFrame:
    """read_pedals of documents (perf_id, xml) in a table, each with its own perf_id."""
    said = F.from_xml("xml", F.lit(f"global struct<pedalMap:{_PEDALS}>"), {"attributePrefix": "_"})
    return _pedals(documents.select("perf_id", F.posexplode(said["global"]["pedalMap"]["pedal"]).alias("seq", "p")))


def _pedals(rows: DataFrame) -> DataFrame:
    p = lambda c: F.col("p").getField(f"_{c}")
    return rows.select(
        "perf_id", F.col("seq").cast("long").alias("seq"), p("xml:id").alias("pedal_id"), p("type").alias("type"), p("date").cast("long").alias("date"), p("date.end").cast("long").alias("date_end"),
        F.coalesce(p("midi.onset"), F.lit(0.0)).alias("onset"), p("midi.duration").alias("midi_duration"), p("source").alias("source"),
    )


def read_time_signatures(spark: SparkSession, path: str) -> DataFrame:
    kind = "dated struct<timeSignatureMap:struct<timeSignature:struct<_numerator:int,_denominator:int>>>"
    rows = spark.read.format("xml").option("rowTag", "global").option("attributePrefix", "_").schema(kind).load(path)
    t = "dated.timeSignatureMap.timeSignature"
    return rows.select(F.xxhash64(F.input_file_name()).alias("perf_id"), F.col(f"{t}._numerator").alias("ts_numerator"), F.col(f"{t}._denominator").alias("ts_denominator"))


def _quoted(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _attribute(name: str, value: Column) -> Column:
    text = value.cast("string")
    text = F.when(text.endswith(".0"), F.substring(text, F.lit(1), F.length(text) - 2)).otherwise(text)
    return F.coalesce(F.concat(F.lit(f' {name}="'), _quoted(text), F.lit('"')), F.lit(""))


def to_xml(notes: DataFrame, meta: DataFrame, intermediate: bool = False, pedals: DataFrame | None = None) -> DataFrame:
    """perf_id and xml: the score of each performance, its parts with their notes by date, and its pedals by onset.

    Without intermediate the physical values of notes are left out. The section ends with the last date, and each
    part begins with program 0. A performance is one document, so its notes come together in one row.
    """
    score = [("xml:id", "note_id"), ("date", "date"), ("pitchname", "pitchname"), ("octave", "octave"), ("accidentals", "accidentals"), ("midi.pitch", "midi_pitch"), ("duration", "duration")]
    physical = [("midi.onset", "onset"), ("midi.duration", "midi_duration"), ("midi.velocity", "velocity")]
    have = set(notes.columns)
    one = F.concat(F.lit("<note"), *[_attribute(a, F.col(c)) for a, c in score + (physical if intermediate else []) if c in have], F.lit("/>"))
    rows = notes.select("perf_id", "part", "date", "seq", one.alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("date", "seq", "x"))), lambda n: n.x), "")
    parts = rows.groupBy("perf_id", "part").agg(body.alias("body"), F.max("date").alias("end"))
    xml = F.concat(F.lit('<part name="part'), F.col("part"), F.lit('" number="'), F.col("part"), F.lit('" midi.channel="'), F.col("part") - 1, F.lit('" midi.port="0"><header/><dated><programChangeMap><programChange date="0" value="0"/></programChangeMap><score>'), F.col("body"), F.lit("</score></dated></part>"))
    pieces = parts.groupBy("perf_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", xml.alias("x")))), lambda p: p.x), "").alias("parts"), F.max("end").alias("end"))
    pieces = pieces.join(meta, "perf_id", "left")
    signature = F.concat(F.lit('<timeSignatureMap><timeSignature date="0" numerator="'), F.coalesce("ts_numerator", F.lit(4)), F.lit('" denominator="'), F.coalesce("ts_denominator", F.lit(4)), F.lit('"/></timeSignatureMap>'))
    section = F.concat(F.lit('<sectionMap><section date="0" date.end="'), F.col("end"), F.lit('"/></sectionMap>'))
    treads = F.lit("<pedalMap/>")
    if pedals is not None:
        own = [("xml:id", "pedal_id"), ("type", "type"), ("date", "date"), ("date.end", "date_end"), ("midi.onset", "onset"), ("midi.duration", "midi_duration"), ("source", "source")]
        one = F.concat(F.lit("<pedal"), *[_attribute(a, F.col(c)) for a, c in own if c in pedals.columns], F.lit("/>"))
        body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("onset", "pedal_id", one.alias("x")))), lambda p: p.x), "")
        pieces = pieces.join(pedals.groupBy("perf_id").agg(body.alias("treads")), "perf_id", "left")
        treads = F.coalesce(F.concat(F.lit("<pedalMap>"), "treads", F.lit("</pedalMap>")), treads)
    head = F.lit(f'<msm title="aligned performance" pulsesPerQuarter="{PPQ}"><global><header/><dated>')
    return pieces.select("perf_id", F.concat(head, signature, section, F.lit("</dated>"), treads, F.lit("</global>"), F.col("parts"), F.lit("</msm>")).alias("xml"))
