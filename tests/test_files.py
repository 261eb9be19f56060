import io
import tarfile

import pandas as pd

from plansift.catalog import datasets
from plansift.sources import archives, labels


def test_archives_and_arrays_are_made_and_read_in_bounded_parts(monkeypatch):
    many = pd.DataFrame({"archive": range(1000), "n": 2, "d": 1})
    packed = list(datasets.pack_archives([many]))
    assert max(len(part) for part in packed) <= 256 and sum(len(part) for part in packed) == 1000
    shapes = pd.DataFrame({"sample_id": range(200), "h": 3, "w": 9})
    files = list(labels.encode_test_labels([shapes]))
    assert max(len(part) for part in files) <= 64 and sum(len(part) for part in files) == 200
    whole = pd.concat(labels._decode(files))
    monkeypatch.setattr(labels, "RUNS", 100)
    parts = list(labels._decode([pd.concat(files)]))
    assert max(len(part) for part in parts) < 200 and pd.concat(parts).reset_index(drop=True).equals(whole.reset_index(drop=True))


def test_a_long_archive_is_scanned_whole_or_to_its_limit(spark, monkeypatch):
    monkeypatch.setattr(archives, "MEMBERS", 16)
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w") as tar:
        for i in range(100):
            info = tarfile.TarInfo("d" * (120 * (i % 2)) + f"/f{i}")
            info.size = i
            tar.addfile(info, io.BytesIO(bytes(i)))
    empty = io.BytesIO()
    tarfile.open(fileobj=empty, mode="w").close()
    df = spark.createDataFrame([(1, buffer.getvalue()), (2, empty.getvalue()), (3, buffer.getvalue())], "archive long, content binary")
    want = [(a, i, "d" * (120 * (i % 2)) + f"/f{i}") for a in (1, 3) for i in range(100)]
    assert sorted(map(tuple, archives.scan(df).collect())) == want
    assert sorted(map(tuple, archives.scan(df, 3).collect())) == [w for w in want if w[1] < 3]
