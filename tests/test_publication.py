"""Publication: whole or not at all."""

import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.sources import publication
from auditlake.sources.publication import PublicationError, publish, verified


def files(spark, **texts):
    return spark.createDataFrame([(k.replace("_", "."), v) for k, v in texts.items()], "name string, text string")


def content(path):
    return {p.name: p.read_text() for p in path.iterdir() if not p.name.startswith(".") and p.name != publication.MANIFEST}


def test_files_and_manifest(spark, tmp_path):
    got = publish(files(spark, a_xml="<a>\n\n é</a>\n", b_csv="x,y\n1,2", c_txt=""), f"file://{tmp_path}/out")
    assert content(tmp_path / "out") == {"a.xml": "<a>\n\n é</a>\n", "b.csv": "x,y\n1,2\n", "c.txt": "\n"}
    assert got.files[0] == ("a.xml", 13, hashlib.sha256("<a>\n\n é</a>\n".encode()).hexdigest()) and not got.replaced
    assert verified(spark, f"file://{tmp_path}/out") == list(got.files)
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    (tmp_path / "out" / "b.csv").write_text("else\n")
    for crc in (tmp_path / "out").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(PublicationError, match="integrity_mismatch"):
        verified(spark, f"file://{tmp_path}/out")


def test_no_clobber_and_replace(spark, tmp_path):
    target = f"file://{tmp_path}/out"
    publish(files(spark, a_txt="1", old_txt="2"), target)
    with pytest.raises(PublicationError, match="target_exists"):
        publish(files(spark, a_txt="3"), target)
    assert publish(files(spark, a_txt="3"), target, replace=True, dry_run=True).replaced and content(tmp_path / "out") == {"a.txt": "1\n", "old.txt": "2\n"}
    assert publish(files(spark, a_txt="3"), target, replace=True).replaced and content(tmp_path / "out") == {"a.txt": "3\n"}
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_a_failing_write_leaves_the_old_files(spark, tmp_path):
    target = f"file://{tmp_path}/out"
    publish(files(spark, a_txt="old"), target)
    state = tmp_path / "counted"

    @F.udf(T.StringType())
    def fails_second_time(text):
        # The checksums are computed first; the write then meets an error.
        if state.exists():
            raise ValueError("lost")
        return text

    bad = files(spark, a_txt="new", b_txt="new").withColumn("text", fails_second_time("text"))
    publish(bad, target, replace=True, dry_run=True)
    state.write_text("")
    with pytest.raises(Exception, match="lost"):
        publish(bad, target, replace=True)
    assert content(tmp_path / "out") == {"a.txt": "old\n"} and verified(spark, target)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["counted", "out"]


def test_what_was_written_is_verified(spark, tmp_path, monkeypatch):
    target = f"file://{tmp_path}/out"
    publish(files(spark, a_txt="old"), target)
    monkeypatch.setattr(publication, "checked", lambda f: [("a.txt", 4, "0" * 64)])
    with pytest.raises(PublicationError, match="integrity_mismatch"):
        publish(files(spark, a_txt="new"), target, replace=True)
    assert content(tmp_path / "out") == {"a.txt": "old\n"} and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_a_failing_swap_puts_the_old_files_back(spark, tmp_path, monkeypatch):
    target = f"file://{tmp_path}/out"
    publish(files(spark, a_txt="old"), target)
    move = publication.Store.move

    def refuses(self, old, new):
        if old.endswith("/files"):
            raise PublicationError("rename_failed")
        move(self, old, new)

    monkeypatch.setattr(publication.Store, "move", refuses)
    with pytest.raises(PublicationError, match="rename_failed"):
        publish(files(spark, a_txt="new"), target, replace=True)
    assert content(tmp_path / "out") == {"a.txt": "old\n"} and [p.name for p in tmp_path.iterdir()] == ["out"]


@pytest.mark.parametrize("name", ["../a", "a/b", "", "a.", ".a", "CON.txt", "com1", "a b", publication.MANIFEST, None])
def test_unsafe_names(spark, tmp_path, name):
    with pytest.raises(PublicationError, match="invalid_logical_filename"):
        publish(spark.createDataFrame([(name, "x")], "name string, text string"), f"file://{tmp_path}/out")
    assert list(tmp_path.iterdir()) == []


def test_names_that_a_system_takes_for_one(spark, tmp_path):
    with pytest.raises(PublicationError, match="duplicate_logical_filename"):
        publish(files(spark, a_txt="1", A_txt="2"), f"file://{tmp_path}/out")


def test_nothing_to_publish(spark, tmp_path):
    assert publish(spark.createDataFrame([], "name string, text string"), f"file://{tmp_path}/out").files == ()
    assert content(tmp_path / "out") == {}
