import numpy as np
import pytest
from tokenizers import Tokenizer

from shardflow.llm import token_scan
from shardflow.llm.queries import END, VOCABULARY, queries
from shardflow.llm.token_scan import document_tokens, scan, scan_files, write_files
from tests.conftest import SMALL
from tests.llm import cases


def brute(rows):
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return sorted(((i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows), key=repr)


def counts(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_tokens").collect()), key=repr)


@pytest.mark.parametrize("block", [1, 7, 1000, 1 << 18])
def test_awkward_rows(spark, tmp_path, block):
    rows = [(r[0], r[1]) for r in cases.awkward() if block > 7 or r[0] != 8] + [(70, "<|endoftext|> is text <|endoftext|>")]
    df = cases.docs(spark, [(i, t, "en", "web", 1) for i, t in rows])
    assert counts(document_tokens(df, f"file://{tmp_path}/flat", VOCABULARY, END, block)) == brute(rows)


def test_files_hold_ids_alone(spark, tmp_path):
    rows = [(i, cases.prose(20 + i, i)) for i in range(30)] + [(99, None)]
    noted = write_files(cases.of(spark, dict(rows)), str(tmp_path / "flat"), VOCABULARY, END).collect()
    t = Tokenizer.from_file(VOCABULARY)
    text = dict(rows)
    by = {}
    for r in sorted(noted, key=lambda r: (r["file"], r["first"])):
        by.setdefault(r["path"], []).extend(r["doc_ids"])
    for path, who in by.items():
        want = [x for i in who for x in (*t.encode(text[i] or "", add_special_tokens=False).ids, END)]
        assert np.fromfile(path, "<u2").tolist() == want
    assert sorted(i for who in by.values() for i in who) == sorted(text)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = queries()["op9_token_counts"](spark, SMALL)
    assert counts(got) == brute(rows)
    each = got.groupBy("file").agg({"document": "max", "*": "count"}).collect()
    assert all(r["max(document)"] + 1 == r["count(1)"] for r in each)


def brute_scan(files, end):
    out = []
    for name, ids in files.items():
        n = k = 0
        for x in ids:
            if x == end:
                out.append((name, k, n))
                n, k = 0, k + 1
            else:
                n += 1
        if n:
            out.append((name, k, n))
    return sorted(out, key=repr)


@pytest.mark.parametrize("kind", ["<u2", "<u4"])
@pytest.mark.parametrize("group", [1, 2, 1024])
def test_any_files_and_cuts(spark, monkeypatch, kind, group):
    """Random files with separators at every place, also first, last, doubled and none; blocks of all lengths, some empty."""
    monkeypatch.setattr(token_scan, "GROUP", group)
    rng = np.random.default_rng(group)
    files = {i: rng.choice([3, 5, 9], int(rng.integers(0, 60)), p=[0.5, 0.3, 0.2]).tolist() for i in range(20)}
    files |= {20: [9], 21: [9, 9], 22: [1, 2], 23: [], 24: [1, 9, 2], 25: [9, 1]}
    rows = []
    for name, ids in files.items():
        at = block = 0
        while at < len(ids) or block == 0:
            n = int(rng.integers(0, 7))
            rows.append((name, block, np.array(ids[at : at + n], kind).tobytes() if n or name % 2 else None))
            at, block = at + n, block + 1
    df = spark.createDataFrame(rows, "file int, block bigint, ids binary").repartition(4)
    assert cases.rows(scan(df, 9, kind)) == brute_scan(files, 9)


@pytest.mark.parametrize("kind", ["<u2", "<u4"])
@pytest.mark.parametrize("block", [1, 3, 64])
def test_files_written_by_hand(spark, tmp_path, kind, block):
    """Ranges of all lengths against a walk through the files; some are empty, some end without a separator."""
    rng = np.random.default_rng(block)
    files = {i: rng.choice([3, 5, 9], int(rng.integers(0, 200)), p=[0.5, 0.4, 0.1]).tolist() for i in range(12)}
    files |= {20: [9], 21: [9, 9], 22: [1, 2], 23: [], 24: [1, 9, 2], 25: [9, 1]}
    rows = []
    for name, ids in files.items():
        np.array(ids, kind).tofile(tmp_path / f"f{name}.bin")
        rows.append((name, f"file://{tmp_path}/f{name}.bin", (tmp_path / f"f{name}.bin").stat().st_size))
    df = spark.createDataFrame(rows, "file int, path string, bytes bigint")
    assert cases.rows(scan_files(df, 9, kind, block)) == brute_scan(files, 9)


def test_missing_files_are_an_error(spark, tmp_path):
    df = spark.createDataFrame([(1, f"file://{tmp_path}/none.bin", 10)], "file int, path string, bytes bigint")
    with pytest.raises(Exception, match="none.bin"):
        scan_files(df, 9).collect()


def test_empty_and_clashes(spark, tmp_path):
    assert cases.rows(document_tokens(cases.docs(spark, []), f"{tmp_path}/a", VOCABULARY, END)) == []
    df = cases.docs(spark)
    assert counts(document_tokens(cases.clashing(df), f"{tmp_path}/b", VOCABULARY, END)) == brute([(r[0], r[1]) for r in cases.awkward()])
