"""Evidence files lexed by many tasks give what parsing them whole gives."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from wardlight.sources import evidence


@pytest.fixture()
def narrow(spark):
    """Files are cut every few kilobytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "4096"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def write(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, data in files.items():
        (folder / name.replace("__", ".")).write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(folder)


def value(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 5)
    if kind == 5:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    if kind >= 6:
        return {word(rng): value(rng, depth + 1) for _ in range(rng.randrange(4))}
    return [word(rng), rng.randrange(10**6), True, None, rng.random() < 0.5][kind]


def word(rng):
    return "".join(rng.choice('ab{}[],:"\\ \n\té€') for _ in range(rng.randrange(12)))


def by_file(records):
    out = {}
    for r in records.orderBy("file", "position").collect():
        out.setdefault(r.file.rsplit("/", 1)[1], []).append((r.position, json.loads(r.record)))
    return out


def test_large_arrays(narrow, tmp_path):
    """One line or many, nested, with braces and quotes in strings: one file of many pieces."""
    rng = random.Random(5)
    items = [value(rng) for _ in range(300)] + [{"k": k, word(rng): value(rng), "t": word(rng) * 20} for k in range(500)]
    rng.shuffle(items)
    folder = write(
        tmp_path / "f",
        flat__json=json.dumps(items),
        pretty__json=json.dumps(items, indent=2, ensure_ascii=False),
        one__json=" \n " + json.dumps({"a": {"b": [1, {"c": "}"}]}}) + "\n",
        Upper__JSON="[" + json.dumps({"a": 1}) + "]",
        none__json="[1, 2, [3]]",
        empty__json="",
    )
    read = evidence.pieces(narrow, folder, ["json"], "}")
    tasks = read.where(F.col("file").endswith("flat.json")).select("block").distinct().count()
    assert tasks > 20
    got = by_file(evidence.json_records(read))
    want = [x for x in items if isinstance(x, dict)]
    for name in ("flat.json", "pretty.json"):
        assert [p for p, _ in got[name]] == list(range(len(want)))
        assert [v for _, v in got[name]] == want
    assert got["one.json"] == [(0, {"a": {"b": [1, {"c": "}"}]}})] and got["Upper.JSON"] == [(0, {"a": 1})]
    assert set(got) == {"flat.json", "pretty.json", "one.json", "Upper.JSON"}


def test_malformed_files_have_no_records(spark, tmp_path):
    good = '{"a": 1}'
    wrong = {
        "open": f"[{good}, {good}", "cut": f'[{good}, {{"b": ', "comma": f"[{good},]", "lead": f"[,{good}]", "gap": f"[{good} {good}]", "more": f"[{good}] x",
        "twice": f"[{good}]]", "two": good + good, "text": "nothing", "half": '{"a": 1', "quote": f'[{good}, "x]', "after": f"{good} 1", "inner": f"[{good}, {{bad}}]",
    }
    right = {"array": f"[{good}, 7, {good}]", "object": good, "spaces": f"\n[ {good}\n ,\t{good} ]\n", "mark": f"[{good}]"}
    folder = write(tmp_path / "f", **{f"{k}__json": v for k, v in {**wrong, **right}.items()})
    got = by_file(evidence.json_records(evidence.pieces(spark, folder, ["json"], "}")))
    assert {k: len(v) for k, v in got.items()} == {"array.json": 2, "object.json": 1, "spaces.json": 2, "mark.json": 1}


def test_large_csv(narrow, tmp_path):
    rng = random.Random(6)
    table = [["name", "note, long", "n"]]
    table += [[f"r{k}", "".join(rng.choice('ab,"\n\r ') for _ in range(rng.randrange(40))) + "x", str(k)] for k in range(900)]
    files = {}
    for name, end in (("unix", "\n"), ("dos", "\r\n")):
        out = io.StringIO(newline="")
        csv.writer(out, lineterminator=end, quoting=csv.QUOTE_ALL).writerows(table)
        files[f"{name}__csv"] = out.getvalue()
    files["head__csv"], files["blank__csv"], files["short__csv"] = "a,b\n", "\n\n", "\r\na,b,c\n1,2\n\n3,4,5,6\n"
    folder = write(tmp_path / "f", **files)
    read = evidence.pieces(narrow, folder, ["csv"], "\n")
    assert read.where(F.col("file").endswith("dos.csv")).select("block").distinct().count() > 5
    got = by_file(evidence.csv_records(read))
    want = [(k, dict(zip(table[0], row))) for k, row in enumerate(table[1:])]
    assert got["unix.csv"] == want and got["dos.csv"] == want
    assert got["short.csv"] == [(0, {"a": "1", "b": "2"}), (1, {"a": "3", "b": "4", "c": "5"})]
    assert set(got) == {"unix.csv", "dos.csv", "short.csv"}


def test_lines_and_gates(narrow, tmp_path):
    lines = "".join(f'{{"k": {k}}}\n' if k % 3 else "no object\r\n" for k in range(2000))
    folder = write(
        tmp_path / "f",
        some__jsonl=lines,
        mixed__log=lines,
        plain__txt="one\n\n two  three\n",
        array__log='[\n{"a":\n1},\n{"b": 2}]',
        binary__json=b'[{"a": "\xff"}]',
        nul__csv="a\n\0\n",
        nul__txt="x\0",
    )
    records, verdicts = evidence.read_evidence(narrow, folder)
    got = by_file(records)
    want = [(n, {"k": k}) for n, k in enumerate(k for k in range(2000) if k % 3)]
    assert got["some.jsonl"] == want and got["mixed.log"] == want
    assert [v["message"] for _, v in got["plain.txt"]] == ["one", "two", "three"]
    assert got["array.log"] == [(0, {"a": 1}), (1, {"b": 2})]
    of = {r.file.rsplit("/", 1)[1]: r.verdict for r in verdicts.collect()}
    refused = {"binary.json", "nul.csv", "nul.txt"}
    assert of == {name: "BINARY_CONTENT_REJECTED" if name in refused else "accepted" for name in of} and refused < set(of) and not refused & set(got)


def test_empty_partitions_are_no_files(spark, tmp_path):
    """Only rows become records: a partition without any leaves no array that a log would show as a line."""
    from wardlight.plans import samples

    rows = spark.range(10).repartition(4, F.col("id") % 2).select(F.col("id").cast("string").alias("message"))
    samples.write_json_arrays(rows, str(tmp_path / "logs"), ".log")
    records, verdicts = evidence.read_evidence(spark, str(tmp_path / "logs"))
    assert sorted(json.loads(r.record)["message"] for r in records.collect()) == sorted(map(str, range(10)))
    assert {r.verdict for r in verdicts.collect()} == {"accepted"}
