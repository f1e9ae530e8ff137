"""Archives read in one pass: limits, listings, odd members."""

import io
import tarfile

import pytest

from orefold.sources import archive

ROWS = "archive string, path string, text string"
LIST = "archive string, path string, size bigint"


def tar(at, *members):
    with tarfile.open(at, "w:gz") as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            if data is None:
                info.type = tarfile.DIRTYPE
            elif isinstance(data, str):
                info.type, info.linkname = tarfile.SYMTYPE, data
            else:
                info.size = len(data)
            t.addfile(info, io.BytesIO(data) if isinstance(data, bytes) else None)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_members_of_archives(spark, tmp_path):
    tar(tmp_path / "a.tar.gz", ("r", None), ("r/x.js", b"one"), ("r/x.js", b"two"), ("r/d/y\xe9.md", "z\xe9".encode()), ("loose", b"no"), ("r/link", "x.js"), ("r/bad", b"a\xff"), ("r/empty", b""), ("r/long", b"l" * 2000))
    (tmp_path / "in").mkdir()
    tar(tmp_path / "in" / "none.tar.gz")
    tar(tmp_path / "in" / "b.tar.gz", ("r/x.js", b"b"))
    (tmp_path / "other.txt").write_text("no archive")
    got = archive.read(spark, f"file://{tmp_path}", maxBytes=1000)
    assert rows(got) == [("a", 1, "x.js", 3, "one"), ("a", 2, "x.js", 3, "two"), ("a", 3, "d/y\xe9.md", 3, "z\xe9"), ("a", 4, "bad", 2, "a�"), ("a", 5, "empty", 0, ""), ("a", 6, "long", 2000, None), ("b", 1, "x.js", 1, "b")]
    assert {r.text for r in archive.read(spark, str(tmp_path / "a.tar.gz"), texts="false").collect()} == {None}
    listing = spark.createDataFrame([("a", "x.js", 3), ("a", "x.js", 9), ("a", "long", None), ("b", "x.js", 5), (None, "x.js", 1)], LIST)
    assert rows(archive.wanted(got, listing)) == [("a", "long", 2000, None), ("a", "x.js", 3, "two"), ("b", "x.js", 1, "b")]
    assert rows(archive.wanted(got, listing.limit(0))) == []
    for bad, said in ((("a", "gone", 1), "no listed file a/gone"), (("a", "x.js", 2), "larger than listed: a/x.js")):
        with pytest.raises(Exception, match=said):
            archive.wanted(got, spark.createDataFrame([bad], LIST)).collect()


def test_too_many_files_are_an_error(spark, tmp_path):
    tar(tmp_path / "a.tar.gz", *[(f"r/{i}", b"") for i in range(12_001)])
    with pytest.raises(Exception, match="more than 12000 files"):
        archive.read(spark, f"file://{tmp_path}").collect()
    assert archive.read(spark, f"file://{tmp_path}", maxFiles=12_001).count() == 12_001
    whole = (tmp_path / "a.tar.gz").read_bytes()
    (tmp_path / "a.tar.gz").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Exception):
        archive.read(spark, f"file://{tmp_path}", maxFiles=12_001).collect()


def test_what_is_written_is_read(spark, tmp_path):
    files = [(f"p{i % 7}", f"d/{i}.md", "x" * i if i % 5 else None) for i in range(200)]
    archive.write(spark.createDataFrame(files + [(None, "a", "b"), ("p", "", "b"), ("p", None, "b")], ROWS), f"file://{tmp_path}/out", 3)
    got = archive.read(spark, f"file://{tmp_path}/out").drop("seq")
    assert rows(got) == sorted((a, p, len(t or ""), t or "") for a, p, t in files)
    assert not list((tmp_path / "out").glob("*.part"))
