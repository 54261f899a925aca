"""UTF-16 text read in blocks gives the rows of a whole-file read, wherever the blocks are cut."""

import random

import pytest

from tasador.sources import files, wide_text


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def written(path, encoding, lines=900, end="\n"):
    rng = random.Random(3)
    texts = ["Piso ñ", 'dice ""hola""', "una;dos", "línea\notra", "\n\n", "ਊ੊Ċ", "x" * 300, "fin\r\nde", "", "日本"]
    rows = []
    for i in range(lines):
        quoted = [f'"{rng.choice(texts)}"' for _ in range(3)]
        rows.append(";".join([str(i), *quoted, "plain ਊ"]))
        if i % 50 == 0:
            rows.append("")
    path.write_bytes(end.join(["id;a;b;c;d", *rows, ""]).encode(encoding))
    return str(path)


@pytest.mark.parametrize("encoding, block", [("utf-16", 1000), ("utf-16", 997), ("utf-16", 4001), ("utf-16be", 2999), ("utf-16", 10**8)])
def test_blocks_equal_the_whole(spark, tmp_path, encoding, block):
    path = written(tmp_path / "raw.csv", encoding)
    whole = {"header": True, "sep": ";", "encoding": encoding, "multiLine": True, "escape": '"'}
    want = rows_of(spark.read.options(**whole).csv(path))
    assert len(want) == 900
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in keep:
            spark.conf.set(k, str(block))
        frame = wide_text.read_wide_csv(spark, path, encoding="UTF-16BE" if encoding == "utf-16be" else None)
        assert rows_of(frame) == want
        tasks = spark.read.option("lineSep", "\n").option("encoding", "UTF-16LE").text(path).rdd.getNumPartitions()
        assert tasks > 10 or block > 10**6
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_several_files_carriage_returns_and_nothing(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    for name, first in (("a", 1), ("b", 3)):
        text = f'id;Titulo;Precio\r\n{first};"uno\r\ndos";1.5\r\n{first + 1};x;\r\n'
        (folder / f"{name}.csv").write_bytes(text.encode("utf-16"))
    got = rows_of(wide_text.read_wide_csv(spark, str(folder)))
    assert [r[0] for r in got] == ["1", "2", "3", "4"] and got[0][1] == "uno\r\ndos" and got[1][2] is None
    typed = files.read_raw_listings(spark, str(folder)).orderBy("id").collect()
    assert [(r["id"], r["Precio"]) for r in typed] == [(1, 1.5), (2, None), (3, 1.5), (4, None)]
    (tmp_path / "none.csv").write_bytes(b"")
    assert wide_text.read_wide_csv(spark, str(tmp_path / "none.csv")).collect() == []
    (tmp_path / "head.csv").write_bytes("id;a\n".encode("utf-16"))
    assert wide_text.read_wide_csv(spark, str(tmp_path / "head.csv")).collect() == []


def test_a_record_longer_than_blocks(spark, tmp_path):
    body = "\n".join(f"line {i}" for i in range(4000))
    (tmp_path / "long.csv").write_bytes(f'id;a\n1;"{body}"\n2;end\n'.encode("utf-16"))
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3001")
        got = rows_of(wide_text.read_wide_csv(spark, str(tmp_path / "long.csv")))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    assert got == [("1", body), ("2", "end")]
