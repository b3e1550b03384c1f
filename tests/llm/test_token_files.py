import json
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from tokenizers import Tokenizer

from aerolytics.llm import ans, token_files
from aerolytics.llm.common import shared_dir

MODEL = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(MODEL)


def library(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\t\r\x0b\x85\xa0᠎​ 　\x1cab1'.,sé中<|>")), max_size=30))
def test_parts_give_the_ids_of_the_whole_text(text):
    assert token_files.words(MODEL).ids([text])[0].tolist() == library(text)


@pytest.mark.parametrize("text", ["a <|endoftext|> b", " <|endoftext|>", "x<|endoftext|>  y ", "don't  stop\n\n now 12 ", " ", "  ", "", "᠎ a ᠎b", "é ́x"])
def test_special_strings_and_blanks(text):
    assert token_files.words(MODEL).ids([text])[0].tolist() == library(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), max_size=70), max_size=12))
def test_blocks_round_trip(blocks):
    arrays = [np.array(b, np.uint32) for b in blocks]
    counts = np.bincount(np.concatenate([*arrays, np.zeros(1, np.uint32)]).astype(np.int64), minlength=50)
    table = ans.Table.from_bytes(ans.scaled_table(counts).to_bytes())
    made = ans.encode(arrays, table)
    assert [x.tolist() for x in ans.decode(made, np.array(list(map(len, arrays))), table)] == blocks


def test_codec_comes_near_the_entropy_and_tells_damage():
    dice = np.random.default_rng(3)
    ids = (dice.zipf(1.4, 200_000) % 5_000).astype(np.uint32)
    counts = np.bincount(ids, minlength=5_000)
    table = ans.scaled_table(counts)
    assert int(table.freq[:-1].sum()) == 1 << table.bits and (table.freq[:-1][counts > 0] > 0).all()
    blocks = [ids[i : i + 4_096] for i in range(0, len(ids), 4_096)]
    made = ans.encode(blocks, table)
    share = counts[counts > 0] / len(ids)
    assert 8 * sum(map(len, made)) / len(ids) < 1.03 * -(share * np.log2(share)).sum()
    spoilt = bytearray(made[0])
    spoilt[100] ^= 1
    with pytest.raises(ValueError):
        assert (ans.decode([bytes(spoilt)], np.array([4_096]), table)[0] == blocks[0]).all() or pytest.fail("damage went unseen")
    with pytest.raises(ValueError):
        ans.encode([np.array([4_999 if not counts[4_999] else int(np.flatnonzero(counts == 0)[0])])], table)


def expected(rows):
    at, out = 0, []
    for doc_id, ids in sorted(((d, [*library(t), 2]) for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(np.array(r[1], "<u4").tobytes()))):
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    return out


@pytest.fixture(scope="module")
def rows():
    dice = np.random.default_rng(1)
    word = lambda: "".join(dice.choice(list("abcdeé"), dice.integers(1, 7)))
    made = [(int(i), " ".join(word() for _ in range(dice.integers(0, 60)))) for i in dice.permutation(300)]
    made += [(7, "same id"), (7, "same id"), (None, "no id"), (None, None), (1_000, ""), (1_001, None), (-5, "before all"), (500, "long " * 30_000)]
    return made + [(9, "hot")] * 200


def test_files_equal_the_library_read_back_in_slices(spark, rows):
    folder = shared_dir(spark)
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, ids string, file int").repartition(7)
    token_files.write_token_files(docs, folder, MODEL, 2, file_ids=20_000)
    found = token_files.read_token_files(spark, folder, slice_ids=3_000)
    assert sorted(map(tuple, found.collect()), key=lambda r: r[1]) == expected(rows)
    base = folder.removeprefix("file://")
    files = json.load(open(f"{base}/_manifest.json"))["files"]
    assert len(files) > 4 and {f["name"] for f in files} == {n for n in os.listdir(base) if n.endswith(".ans")}
    assert max(f["docs"] for f in files) < len(rows) / 3  # rows of one id spread
    with open(f"{base}/{files[1]['name']}", "r+b") as held:
        held.seek(40)
        held.write(b"\xff\x00\xff")
    with pytest.raises(PySparkException, match="damaged"):
        token_files.read_token_files(spark, folder).collect()


def test_empty_table(spark):
    folder = shared_dir(spark)
    token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), folder, MODEL, 2)
    found = token_files.read_token_files(spark, folder, keep_ids=False)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and found.count() == 0


def test_only_named_files_count(tmp_path):
    """What a doubled or failed attempt left is no part of the folder; an aborted write takes its files away."""
    options = {"path": str(tmp_path), "starts": "[0]", "file_ids": "100000"}
    table = ans.scaled_table(np.bincount([1, 2, 2, 3]))
    (tmp_path / "tables.bin").write_bytes(token_files._sealed(table.to_bytes()))
    ids = np.array([1, 2, 2, 3], "<u4")
    payload = ans.encode([ids], table)[0]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"file": 0, "named": True, "doc_id": 5, "n": 4, "crc": zlib.crc32(ids), "sizes": [len(payload)], "payload": payload}])
    first, twin, lost = (token_files._Writer(options).write(iter([batch])) for _ in range(3))
    writer = token_files._Writer(options)
    writer.abort([lost, None])
    assert len([p for p in tmp_path.iterdir() if p.suffix == ".ans"]) == 2
    writer.commit([first, None])
    assert [p.name for p in tmp_path.iterdir() if p.suffix == ".ans"] == [first.files[0]["name"]] != [twin.files[0]["name"]]
    reader = token_files._Reader({"path": str(tmp_path)})
    assert [b.to_pylist() for part in reader.partitions() for b in reader.read(part)] == [[{"doc_id": 5, "start": 0, "n_tokens": 4, "ids_crc32": zlib.crc32(ids), "ids": [1, 2, 2, 3]}]]
