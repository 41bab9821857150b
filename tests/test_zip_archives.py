"""s14_zip_csv writes archives of bounded size and loses no row."""

import glob
import io
import os
import random
import zipfile

import pytest

from strata.plans import shaping_catalogue as S
from strata.sources import archives as Z
from tests.conftest import SF0001


def test_archives_are_bounded_and_whole(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(S, "ARCHIVE_CHARS", 5_000, raising=False)
    monkeypatch.setattr(S, "scratch_dir", lambda spark, name: f"{tmp_dir}/{name}")
    got = S.s14_zip_csv(spark, SF0001)
    orders = spark.read.parquet(f"{SF0001}/orders.parquet")
    want = orders.selectExpr("o_orderkey", "o_orderstatus", "o_totalprice", "concat('part', o_orderkey % 2, '.csv') member")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    sizes, kinds = [], []
    for name in glob.glob(f"{tmp_dir}/zip/*.zip"):
        with zipfile.ZipFile(name) as z:
            text = [z.read(n).decode() for n in z.namelist() if n.endswith(".csv")]
        sizes.append(sum(map(len, text)))
        kinds.append({line.split(";")[1] for t in text for line in t.splitlines()[2:]})
    assert len(sizes) > 3 and max(sizes) < 8_000 and all(len(k) == 1 for k in kinds)


class Counting(io.FileIO):
    """A file that counts the bytes read from it."""

    total = 0

    def read(self, size=-1):
        out = super().read(size)
        Counting.total += len(out)
        return out

    def readinto(self, target):
        n = super().readinto(target)
        Counting.total += n
        return n


class Sparse(io.FileIO):
    """Blocks of zeros become holes."""

    def write(self, data):
        if len(data) > 4096 and not any(data):
            self.seek(len(data), 1)
            return len(data)
        return super().write(data)


def test_members_of_a_3_gb_archive_are_read_by_their_ranges(spark, tmp_dir):
    path = f"{tmp_dir}/big.zip"
    with Sparse(path, "w+") as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        z.writestr("first.csv", "a,b\n1,2\n")
        with z.open("zeros.bin", "w", force_zip64=True) as f:
            for _ in range(3 << 7):
                f.write(bytes(8 << 20))
        z.writestr("last.csv", "a,b\n3,4\n5,6\n", zipfile.ZIP_DEFLATED)
    assert os.path.getsize(path) > 3 << 30 and os.stat(path).st_blocks * 512 < 1 << 24
    members = Z.list_members(spark, path)
    assert {r.member: r["size"] for r in members.collect()} == {"first.csv": 8, "zeros.bin": 3 << 30, "last.csv": 12}
    lines = Z.read_zip_lines(spark, path, Z.pick_members(members, "all_csvs"))
    assert sorted((r.member, r.line_no, r.line) for r in lines.collect()) == [
        ("first.csv", 1, "a,b"), ("first.csv", 2, "1,2"), ("last.csv", 1, "a,b"), ("last.csv", 2, "3,4"), ("last.csv", 3, "5,6"),
    ]
    assert Z.read_zip_lines(spark, path, members.where("member = 'last.csv'").select("archive", "member")).count() == 3
    # proof by bytes: the directory and one member cost little of the 3 GB
    Counting.total = 0
    with Counting(path) as raw, zipfile.ZipFile(raw) as z:
        info = z.getinfo("last.csv")
    with Counting(path) as raw:
        own = Z.MemberStream(raw, "last.csv", info.header_offset, info.compress_size, info.compress_type, info.CRC)
        assert io.BufferedReader(own).read() == b"a,b\n3,4\n5,6\n"
    assert Counting.total < 200_000


def test_member_stream_equals_the_content_and_names_damage(tmp_dir):
    rnd = random.Random(2)
    bodies = {"empty": b"", "text": b"line\r\n" * 400_000, "noise": rnd.randbytes(3_000_000)}
    for method in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        path = f"{tmp_dir}/m{method}.zip"
        with zipfile.ZipFile(path, "w", method) as z:
            for name, body in bodies.items():
                z.writestr(name, body)
            infos = {i.filename: i for i in z.infolist()}

        def stream(name, offset=0, crc=0):
            i = infos[name]
            return io.BufferedReader(Z.MemberStream(raw, name, i.header_offset + offset, i.compress_size, i.compress_type, i.CRC ^ crc))

        with open(path, "rb") as raw:
            assert all(stream(name).read() == body for name, body in bodies.items())
            with pytest.raises(ValueError, match="text: checksum"):
                stream("text", crc=1).read()
            with pytest.raises(ValueError, match="no member starts"):
                stream("text", offset=1)
    with pytest.raises(ValueError, match="method 14"):
        Z.MemberStream(io.BytesIO(), "x", 0, 0, zipfile.ZIP_LZMA, 0)
