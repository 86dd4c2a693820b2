"""Toxicity, packing, URL filters, chat threads, languages and archives."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tactuslab.llm import chat, langid, packing, toxicity, url_filter, warc

DOCS = "doc_id long, text string"


def table(spark, rows, kind=DOCS):
    return spark.createDataFrame(rows, kind).repartition(2)


# ---------------------------------------------------------------- toxicity


def test_toxicity_of_held_out_rows_and_odd_texts(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    for k in range(240):
        words = [word() for _ in range(rng.choice([5, 40, 300]))]
        toxic = int(k % 3 == 0)
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), "vuzzling" + rng.choice(["", "s", "ly", "ed", "ness", "est"]))
        rows.append((k, " ".join(words)))
        labels.append((k, toxic))
    docs, known = table(spark, rows), table(spark, labels + [(1, None), (None, 1), (5000, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    odd = [(900, None), (901, ""), (902, "!!!"), (903, "the vuzzlingest"), (903, "the vuzzlingest"), (904, "a " * 60_000), (None, "abc")]
    out = toxicity.score_toxicity(table(spark, rows + odd).withColumn("score", F.lit("clash")), model).withColumn("held_out", toxicity.held_out()).collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 240]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held)
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 == 0) for r in held]) > 0.95
    assert {r["predicted"] for r in out if r["doc_id"] == 903} == {1}
    assert len({r["score"] for r in out if r["doc_id"] in (900, 901, 902)}) == 1


def test_toxicity_without_labels_or_rows(spark):
    docs = table(spark, [(1, "a b")])
    model = toxicity.fit(docs, table(spark, [], "doc_id long, toxic int"))
    assert toxicity.score_toxicity(docs, model).collect()[0]["predicted"] == 0
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


# ---------------------------------------------------------------- packing


def best_cost(points, penalty, size):
    at, cost = [0, *points], [0.0]
    for j in range(1, len(at)):
        pads = [(cost[i], at[j] - at[i]) for i in range(j) if at[j] - at[i] <= size]
        cost.append(min(c + (0 if n & (n - 1) == 0 else size - n) for c, n in pads) + penalty[j - 1] + packing.WINDOW_COST)
    return cost[-1]


@pytest.mark.parametrize("seed", range(8))
def test_windows_cost_least(seed):
    rng = np.random.default_rng(seed)
    points = np.cumsum(rng.integers(1, 30, 120))
    penalty = rng.choice([0.0, 8.0, 64.0], len(points))
    ends = packing.windows(points, penalty, 64)
    assert ends[-1] == points[-1]
    value = dict(zip(points.tolist(), penalty, strict=True))
    n = np.diff([0, *ends])
    cost = sum((0 if k & (k - 1) == 0 else 64 - k) + value[e] + packing.WINDOW_COST for k, e in zip(n.tolist(), ends, strict=True))
    assert n.max() <= 64 and cost == pytest.approx(best_cost(points.tolist(), penalty.tolist(), 64))


def test_packing_is_a_round_trip(spark):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["the", "Größe,", "don't", "a.b.", "É!", "x1", "<|endoftext|>", "straße."]) for _ in range(n))
    rows = [(k, text(rng.choice([0, 1, 3, 50, 700, 4000]))) for k in range(60)] + [(100, None), (101, "word " * 60_000), (102, "z"), (102, "z")]
    own = Tokenizer.from_file(packing.default_vocabulary())
    ids = {i: own.encode(t or "", add_special_tokens=False).ids + [packing.END] for i, t in rows}
    docs = table(spark, rows).withColumn("length", F.lit("clash"))
    for segment in (1 << 20, 5000):
        out = packing.pack(docs, segment_tokens=segment).collect()
        by_doc, by_seq = {}, {}
        for r in out:
            by_doc.setdefault(r["doc_id"], []).append(r)
            by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert set(by_doc) == set(ids)
        for i, pieces in by_doc.items():
            want = ids[i] * (2 if i == 102 else 1)
            assert sum(p["length"] for p in pieces) == len(want) and {p["doc_tokens"] for p in pieces} == {len(ids[i])}
            for p in pieces:
                part = ids[i][p["start"] : p["start"] + p["length"]]
                assert len(part) == p["length"] and p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        for pieces in by_seq.values():
            end = 0
            for offset, length in sorted(pieces):
                assert offset == end
                end += length
            assert end <= packing.SIZE
    assert packing.pack(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- URLs


def brute_url(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1].split("?")[0].split("#")[0]
        host, _, tail = rest.partition("/")
        path = "/" + tail if "/" in rest else ""
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        return host, path, max(fit)[1], max(fit)[2]
    bad = any(x in host + path for x in ("/wp-login.php", "/cgi-bin/", ".ads.", "/track/")) or (host + path).startswith("ads.")
    return host, path, None, "block" if bad else "allow"


def test_urls(spark):
    rng = random.Random(6)
    hosts = ["org", "EXAMPLE.org", "a.example.org", "xexample.org", "b.com", "com", "ads.net", "x.ads.y", "münchen.de", "", "a.b:80", ".org"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/123", "/en/2", "/fr/x", "/de/", "/DE/", "/track/9", "/a/cgi-bin/b", "/wp-login.php", "/é/ü"]
    urls = [f"{s}://{h}{p}{q}" for s in ("http", "") for h in hosts for p in paths for q in ("", "?a=/es/", "#x://y", "?#")]
    urls += [None, "", "nothing", "a//b", "http:/x", "x://y://z/fr/", "http://h.org\n/x", "http://" + "a" * 50_000 + ".org/", "http://b.com/fr/"] + rng.sample(urls, 9)
    d = table(spark, list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("clash"))
    out = url_filter.filter_urls(d).collect()
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out} == {k: brute_url(u) for k, u in enumerate(urls)}
    assert url_filter.filter_urls(d.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(d, ()).collect()} == {"allow"}


def test_rules_are_filed_under_their_rarest_token(spark):
    rules = tuple(url_filter.pattern_rule("block", f"*/common/{k}x/*") for k in range(50))
    d = table(spark, [(k, f"http://h/common/{k}X/q") for k in range(60)] + [(99, "http://h/common/7x")], "page_id long, url string")
    assert url_filter.token_counts(d, rules)["common"] == 61
    low = table(spark, [(k, f"http://h/common/{k}x/q") for k in range(60)], "page_id long, url string")
    assert sorted(r["page_id"] for r in url_filter.filter_urls(low, rules).where("verdict = 'block'").collect()) == list(range(50))
    assert url_filter.pattern_rule("block", "ab*cd/ef*gh").tokens == () and url_filter.host_rule("allow", "a.b", "/c/d").tokens == ("a", "b", "c")


# ---------------------------------------------------------------- chats


def test_threads(spark):
    kind = "conv_id long, turn long, role string, text string"
    rows = [
        (1, 0, "user", "Hello there\nHow do  I sort?"),
        (1, 1, "assistant", "Use sort."),
        (1, 2, "user", "On Monday, X wrote:\n> Hello there\n> how do i SORT?\nMe too"),
        (1, 3, "user", "> On Monday, X wrote:\n> > How do I sort?\n> Me too\nThanks"),
        (1, 4, "user", "> never written\nhm"),
        (1, 7, "user", "late"),
        (2, 0, "user", None),
        (2, 0, "user", None),
        (2, 1, "assistant", "Me too\n> "),
        (None, 1, "user", "lost"),
    ]
    out = {(r["conv_id"], r["turn"]): r for r in chat.link_replies(table(spark, rows, kind).withColumn("root", F.lit("clash"))).collect()}
    got = {k: (r["reply_to"], r["by_quote"], r["root"], r["depth"], r["levels"], r["body"]) for k, r in out.items()}
    assert got == {
        (1, 0): (None, False, 0, 0, 0, "Hello there\nHow do  I sort?"),
        (1, 1): (0, False, 0, 1, 0, "Use sort."),
        (1, 2): (0, True, 0, 1, 1, "Me too"),
        (1, 3): (2, True, 0, 2, 2, "Thanks"),
        (1, 4): (3, False, 0, 3, 1, "hm"),
        (1, 7): (None, False, 7, 0, 0, "late"),
        (2, 0): (None, False, 0, 0, 0, ""),
        (2, 1): (0, False, 0, 1, 1, "Me too"),
        (None, 1): (None, False, 1, 0, 0, "lost"),
    }
    threads = {(r["conv_id"], r["root"]): r["text"] for r in chat.write_threads(chat.link_replies(table(spark, rows, kind))).collect()}
    assert threads[1, 7] == "<|user|>\nlate\n" and threads[1, 0].startswith("<|user|>\nHello") and threads[1, 0].endswith("<|user|>\nhm\n")
    assert chat.link_replies(table(spark, [], kind)).count() == 0


def test_long_threads(spark):
    rows = [(1, k, "user", f"m {k}") for k in range(150)]
    out = chat.link_replies(table(spark, rows, "conv_id long, turn long, role string, text string"))
    assert out.agg(F.max("depth")).collect()[0][0] == 149 and out.select("root").distinct().count() == 1
    assert chat.write_threads(out).count() == 3


# ---------------------------------------------------------------- languages


def test_languages(spark):
    rng = random.Random(7)
    words = {"aa": "the and of with thing", "bb": "der und nicht über für", "cc": "être où leçon déjà les"}
    rows = [(k, " ".join(rng.choice(words[x].split()) for _ in range(rng.choice([4, 30, 200]))), x) for k in range(150) for x in [rng.choice(list(words))]]
    docs = table(spark, rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    odd = [(900, None), (901, ""), (902, "12 !?"), (903, "ü"), (904, "und nicht " * 20_000)]
    out = {r["doc_id"]: r for r in langid.identify(docs.select("doc_id", "text").unionByName(table(spark, odd)).withColumn("score", F.lit("clash")), model).collect()}
    held = [(i, x) for i, _, x in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([out[i]["lang_pred"] == x for i, x in held]) > 0.95
    assert [out[k]["lang_pred"] for k in (900, 901, 902)] == ["und"] * 3 and out[904]["lang_pred"] == "bb"
    assert out[903]["lang_pred"] in words and all(0 <= r["score"] <= 1 for r in out.values())
    none = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = langid.train([], [])
    net.names = ["a", "b"]
    net = langid.LanguageNet(["a", "b"], rng.standard_normal((256, langid.DIM)), [rng.standard_normal((w * langid.DIM, langid.FILTERS)) for w in langid.WIDTHS], [rng.standard_normal(langid.FILTERS) for _ in langid.WIDTHS], rng.standard_normal((langid.FILTERS * 3, 2)), np.zeros(2))
    data, label, weight = rng.integers(97, 105, (4, 20)), np.array([0, 1, 1, 0]), np.ones(4)
    loss = lambda: -np.log(net.probabilities(data)[np.arange(4), label]).mean()
    grads = langid._gradients(net, data, label, weight)
    for part, g in zip([net.vectors, *net.filters, *net.constants, net.out, net.bias], grads, strict=True):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old = part[at]
        part[at] = old + 1e-6
        up = loss()
        part[at] = old - 1e-6
        down = loss()
        part[at] = old
        assert (up - down) / 2e-6 == pytest.approx(g[at], rel=1e-3, abs=1e-6)


# ---------------------------------------------------------------- archives


def test_archives(spark, tmp_path):
    rng = random.Random(8)
    pages = [(k, f"http://h/{k}\r\nX: y", "<html>" + "<p>same words here</p>" * rng.randint(1, 40) + str(k % 37) + "</html>") for k in range(300)]
    pages += [(1000, None, None), (1001, "u", ""), (1002, "u", None), (1003, "ü", "é\r\n\r\nWARC/1.1\r\n"), (1003, "ü", "é\r\n\r\nWARC/1.1\r\n"), (None, "u", "null id"), (None, "u", ""), (1004, "u", "x" * 300_000)]
    d = table(spark, pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = warc.archive_and_read(d, archive_bytes=20_000, sample_bytes=8_000).collect()
    expected = []
    for i, _, h in pages:
        b = (h or "").encode()
        f = first.get(h or "")
        again = f is not None and f != i
        expected.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", f if again else None))
    assert sorted(map(repr, expected)) == sorted(repr((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in out)

    path = f"file://{tmp_path}/a"
    assert warc.write_archives(d, path, min_bytes=10_000).collect()
    back = warc.read_archives(spark, path).collect()
    assert {r["record_type"] for r in back} == {"response"} and sorted(r["payload"] for r in back) == sorted((h or "").encode() for _, _, h in pages)
    assert {r["url"] for r in back if r["page_id"] == 0} == {"http://h/0%0D%0AX: y"}
    files = list((tmp_path / "a").glob("*.warc.zst"))
    assert files and any(int.from_bytes(f.read_bytes()[:4], "little") == warc.SKIPPABLE for f in files) and not list((tmp_path / "a").glob("_*"))
    (tmp_path / "a" / "part-000000-9999-0000.warc.zst").write_bytes(files[0].read_bytes())  # as a lost attempt leaves it
    assert warc.read_archives(spark, path).count() == len(pages)
    assert warc.archive_and_read(d.limit(0)).count() == 0
