"""Content read in chunks of any size gives what the whole gives; small files on Spark's file systems."""

import hashlib

import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from palimpsest.functions.content import Fingerprint
from palimpsest.runtime import SharedFolder
from palimpsest.sources import tree


@given(st.lists(st.sampled_from([b"\r", b"\n", b"\r\n", b"a", b"\0", b"x" * 600, b"y" * 9000, b""])), st.booleans())
def test_chunks(parts, known):
    whole = b"".join(parts)
    one, many = Fingerprint(known), Fingerprint(known)
    one.update(whole)
    for p in parts:
        many.update(p)
    got = many.result()
    assert got == one.result()
    assert got[:2] == (hashlib.sha256(whole).hexdigest(), xxhash.xxh64_hexdigest(whole))
    binary = not known and b"\0" in whole[:512]
    assert got[2] == (None if binary else hashlib.sha256(whole.replace(b"\r\n", b"\n")).hexdigest())


@pytest.mark.parametrize("chunk", [1, 3, 1 << 20])
def test_walk_by_parts(tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(tree, "CHUNK", chunk)
    (tmp_path / "S0/d/e").mkdir(parents=True)
    for name, data in (("a.txt", b"1\r\n2\r"), ("d/b.bin", b"\0\r\n"), ("d/e/c", b"")):
        (tmp_path / "S0" / name).write_bytes(data)
    (tmp_path / "S0/link").symlink_to("d")
    reader = tree._Reader({"path": str(tmp_path)})
    rows = sorted(r for p in reader.partitions() for r in reader.read(p))
    assert len(reader.partitions()) == 2 and [r[1] for r in rows] == ["a.txt", "d/b.bin", "d/e/c", "link"]
    assert rows[0][7] == hashlib.sha256(b"1\n2\r").hexdigest() and rows[1][7] is None and rows[3][10:] == (True, "d")


def test_shared_folder(spark, tmp_path):
    folder = SharedFolder(spark, str(tmp_path / "kb"))
    assert folder.names() == [] and folder.read("p") is None
    for text in ("ä", "b" * 100_000):
        folder.replace("p", text)
        assert folder.read("p") == text
    (tmp_path / "kb" / "p").write_text("changed by hand")
    assert folder.read("p") == "changed by hand" and "p" in folder.names()
    folder.delete("p")
    assert folder.read("p") is None
