"""Scores of a corpus go through one table of documents, not through a folder for each performance."""

import os
from urllib.parse import urlparse

from tactuslab.queries import QUERIES
from tactuslab.sources import msm
from tactuslab.tables import shared_dir

DATA = "/root/testdata/sf0.01"


def test_no_folder_for_each_performance(spark):
    folder = urlparse(shared_dir(spark)).path
    for name in ("score_roundtrip", "pedal_roundtrip"):
        before = set(os.listdir(folder))
        QUERIES[name](spark, DATA).count()
        new = [os.path.join(folder, x) for x in set(os.listdir(folder)) - before]
        assert new and sum(1 for x in new for _ in os.walk(x)) < 20


def test_documents_as_files(spark, tmp_path):
    """Each document's notes and pedals are those of a file of its own, the first onset that is left out included."""
    part = lambda k, *notes: f'<part number="{k}"><dated><score>{"".join(notes)}</score></dated></part>'
    note = lambda i, date, more="": f'<note xml:id="{i}" date="{date}" duration="360" midi.pitch="60"{more}/>'
    pedal = '<global><pedalMap><pedal xml:id="p" type="soft" midi.duration="0.5"/></pedalMap></global>'
    texts = [f"<msm>{pedal}{part(1, note('a', 720), note('b', 0, ' midi.velocity=\"3\"'))}{part(2, note('c', 0))}</msm>", f"<msm><global><pedalMap/></global>{part(1, note('d', 360))}</msm>"]
    for k, text in enumerate(texts):
        (tmp_path / f"{k}.msm").write_text(text)
    documents = spark.createDataFrame(list(enumerate(texts)), "perf_id long, xml string")
    files = f"file://{tmp_path}"
    for got, want in ((msm.notes_of(documents), msm.read_notes(spark, files)), (msm.pedals_of(documents), msm.read_pedals(spark, files))):
        assert got.columns == want.columns
        assert sorted(map(repr, got.drop("perf_id").collect())) == sorted(map(repr, want.drop("perf_id").collect()))
    assert {(x.perf_id, x.note_id, x.seq, x.onset) for x in msm.notes_of(documents).collect()} == {(0, "b", 1, 0.0), (0, "c", 2, 0.0), (0, "a", 3, None), (1, "d", 1, 0.0)}
