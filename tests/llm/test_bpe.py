"""The automaton against the tokenizers library, and exact round trips."""

import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from revaxis.llm import bpe
from revaxis.llm.bpe import Automaton, decode_documents, encode_documents, token_ids
from revaxis.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def automaton():
    with open(PATH, encoding="utf-8") as file:
        return Automaton(file.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    pick = random.Random(3)
    yield from ["", " ", "aaaaaaaaaaaaa", "<|endoftext|>a <|endoftext|>", "don't\n\n  x", "héé ñandú 1234567 ☃日本"]
    for _ in range(1500):
        yield "".join(pick.choice("aeinorst hdl\n.,=-_*#019AB'é") for _ in range(pick.randint(1, 40)))
    yield " ".join("".join(pick.choice("aeinorst") for _ in range(8)) for _ in range(20_000))


def test_ids_and_text(automaton, library):
    for text in texts():
        ids = library.encode(text, add_special_tokens=False).ids
        packed = automaton.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == ids
        assert automaton.decode(packed) == library.decode(ids, skip_special_tokens=False)


def test_full_tables_are_emptied(library, monkeypatch):
    monkeypatch.setattr("revaxis.llm.bpe.WORD_ENTRIES", 10)
    monkeypatch.setattr("revaxis.llm.bpe.TABLE_ENTRIES", 50)
    with open(PATH, encoding="utf-8") as file:
        small = Automaton(file.read())
    for text in list(texts())[:200]:
        assert np.frombuffer(small.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_full_table_is_small(automaton):
    pick = random.Random(5)
    automaton.close()
    tracemalloc.start()
    for _ in range(10_000):
        automaton.word("".join(pick.choice("aeinorstlu") for _ in range(9)).encode())
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    # 388 bytes an entry with an object for each state.
    assert held < 300 * len(automaton._table)


def test_batches_are_encoded_in_parts(spark, monkeypatch):
    monkeypatch.setattr(bpe, "PART_BYTES", 10)
    lengths = [["", "b" * 9, None, "c"], ["d" * 30], [None, "e"], []]
    for texts in ([t for part in lengths for t in part], [], [None]):
        parts = [p.to_pylist() for p in bpe._parts(pa.array(texts, pa.string()))]
        assert [t for part in parts for t in part] == texts
        assert all(sum(len(t or "") for t in part[:-1]) < 10 for part in parts)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["x " * 700_000, None, "", "y", "z " * 700_000])], "i int, text string")
    got = encode_documents(rows.coalesce(1), PATH).collect()
    assert [r["decoded"] for r in sorted(got)] == ["x " * 700_000, "", "", "y", "z " * 700_000]


def test_rows(spark):
    df = spark.createDataFrame(
        [(1, "one two", 5), (1, "one two", 5), (2, None, 6), (None, "", 7)], "doc_id long, text string, ids int"
    )
    coded = encode_documents(df, PATH)
    assert coded.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    rows = sorted(decode_documents(coded, PATH, into="again").withColumn("list", token_ids(coded["ids"])).collect(), key=str)
    assert [r["decoded"] for r in rows] == [r["text"] or "" for r in rows]
    assert [r["again"] for r in rows] == [r["decoded"] for r in rows]
    assert [len(r["list"]) for r in rows] == [r["n_tokens"] for r in rows]
    assert encode_documents(df.limit(0), PATH).count() == 0


def test_query(spark, sf_dir, library):
    got = {r["doc_id"]: r for r in QUERIES["op8_bpe_automaton"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d["text"], add_special_tokens=False).ids
        row = got[d["doc_id"]]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        text = library.decode(ids, skip_special_tokens=False)
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
