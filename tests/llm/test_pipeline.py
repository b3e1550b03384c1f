import re

import numpy as np

import corpus_pipeline
from aerolytics.llm import decontaminate, language, pieces, secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def write_tables(spark, folder):
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words, n))
    item = prose(30)
    one = prose(200)
    texts = [None, "", "123 456", one, one, one.upper(), prose(150), prose(120) + " " + item + " " + prose(20), item[10:150], prose(60) + " password=abc123def456 " + prose(60), prose(3), "z"]
    texts += [texts[9] + " tail", texts[6].replace(" ", "  ") + " " + prose(10), " ".join(texts[9].split()[:90])]
    rows = [(i, t, "en", f"s{i}", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return texts, item


def holds(text, item):
    """Whether ten consecutive words of the item, or all of a shorter one, stand in the text."""
    words, own = (decontaminate.words_of(x.encode()) for x in (text, item))
    size = min(10, len(own))
    windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)}
    return any(tuple(words[i : i + size]) in windows for i in range(len(words) - size + 1))


def shingles(text):
    """Runs of five words; near copies share four fifths of them."""
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stages_and_run(spark, tmp_path):
    texts, item = write_tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {i: t for i, t in enumerate(texts)}
    expected = [
        {i: t for i, t in kept.items() if t and re.search("[^\\W\\d_]", t) and t != "z"},
    ]
    sets = {i: shingles(t) for i, t in expected[0].items()}
    expected.append({i: t for i, t in expected[0].items() if not any(j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in sets)})
    hit = {i: holds(t, item) for i, t in expected[1].items()}
    expected.append({i: t for i, t in expected[1].items() if not hit[i]})
    expected.append({i: re.sub("password=abc123def456", "[SECRET]", t) for i, t in expected[2].items()})
    for (name, stage), rows in zip(corpus_pipeline.STAGES[:4], expected, strict=True):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == COLUMNS
        assert {r.doc_id: r.text for r in docs.collect()} == rows, name
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert sorted(expected[3]) == [3, 6, 9, 10, 14]
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(final) == sorted(expected[3])
    import public_tokenizers

    table = pieces.ChunkTable(public_tokenizers.path("piece_bpe_32k.model"))
    assert all(list(r.ids) == table.lib.encode(expected[3][i]) for i, r in final.items())


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "secrets", "pieces"]
    assert language.UNDETERMINED == "und" and secrets.KINDS[3] == "novel"


def test_stages_keep_extra_columns_of_any_name(spark, tmp_path):
    texts, _ = write_tables(spark, str(tmp_path))
    extra = ["_lang", "_Score", "_kept", "_row", "_ranges", "_items", "fp", "component_id", "a.b", "c`d"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    docs = docs.selectExpr("*", *[f"concat('{i}-', doc_id) as `{n.replace('`', '``')}`" for i, n in enumerate(extra)])
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == names, name
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    rows = docs.collect()
    assert sorted(r.doc_id for r in rows) == [3, 6, 9, 10, 14]
    assert all(r[len(COLUMNS) + i] == f"{i}-{r.doc_id}" for r in rows for i in range(len(extra)))
    last = corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path))
    assert last.count() == 5 and last.columns[: len(names)] == names


def test_stages_of_empty_tables_and_of_nulls(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain, other = "some plain words", "quite another line of words"
    tables = [
        ([], []),
        ([(None,) * 5] * 3, []),
        ([(None, plain, "en", None, None)] * 3 + [(1, other, None, None, None)] * 2, [(None, plain), (1, other)]),
    ]
    for k, (rows, kept) in enumerate(tables):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES[:4]:
            docs = stage(spark, docs, str(tmp_path))
            docs.write.parquet(f"{tmp_path}/{k}{name}")
            docs = spark.read.parquet(f"{tmp_path}/{k}{name}")
        assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) == sorted(kept, key=str)
        assert corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).count() == len(kept)
