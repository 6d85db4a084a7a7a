"""The corpus pipeline on planted cases, stage by stage."""

import random

import pytest

import corpus_pipeline
from ctxloom.llm import shared
from tests.llm.test_operators import check_pack


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    line = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(n))
    texts = {i: "\n".join(line(25) for _ in range(rng.randrange(2, 6))) for i in range(240)}
    toxic = [i for i in texts if i % 8 == 3]
    for i in toxic:
        words = texts[i].split(" ")
        for _ in range(8):
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "nasty", "awful"]))
        texts[i] = " ".join(words)
    shared = line(30)
    for i in (10, 12, 14):
        texts[i] += "\n" + shared
    texts[300] = texts[20]  # an exact copy
    texts[301] = texts[21].replace(" ", "  ", 3)  # equal words: the same fingerprint, the same lines but for blanks
    texts[302] = None
    root = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, "en", "big" if i % 3 else f"s{i % 4}", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, int(i in toxic)) for i in range(240)], "doc_id long, toxic int").write.parquet(f"{root}/labels.parquet")
    return f"file://{root}", texts, set(toxic)


def test_stages(spark, folder):
    path, texts, toxic = folder
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "simhash near-dedup", "source mixing", "best-fit packing"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == columns, name
        docs.write.mode("overwrite").parquet(f"{path}/{name.replace(' ', '-')}")
        docs = spark.read.parquet(f"{path}/{name.replace(' ', '-')}")
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    clean = set(texts) - toxic
    assert set(kept[0]) == clean
    assert 300 not in kept[1] and 302 in kept[1] and clean - {300, 301} <= set(kept[1])
    assert kept[1][10] == texts[10] and kept[1][12].count("\n") == texts[12].count("\n") - 1
    assert set(kept[3]) == set(kept[2]) and clean - {300, 301} <= set(kept[2])
    rows = corpus_pipeline.STAGES[-1][1](spark, docs.dropDuplicates(["doc_id"]), path).collect()
    used, least = check_pack(rows, kept[3])
    assert used <= least + 1


def test_run(spark, folder):
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder[0]).select("doc_id").distinct().collect()} <= set(folder[1]) - folder[2]


def test_short_lines_outlive_a_shared_one(spark):
    """A document of short unique lines loses the line that an earlier one has, and stays; one with only blank lines left goes."""
    shared = "this long line of licence text stands in three of the documents"
    rows = [(1, f"the first document has a long line of its own\n{shared}"), (2, f"roses\nviolets\n\n{shared}\nsugar"), (3, f"{shared}\n \n\t\r")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert got == {1: (rows[0][1], len(rows[0][1])), 2: ("roses\nviolets\n\nsugar", 20)}


def test_a_session_without_a_shared_folder_is_told_so():
    class Conf:
        def get(self, name, default):
            return default

    class Session:
        conf = Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session())


def test_stages_on_empty_and_odd_tables(spark, folder):
    """Null ids, null texts and clashing names through line dedup and near-dedup; an empty table through every stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, __gone string, __of int, __toxicity double"
    line = "one line of a text that stands in two rows of the table"
    docs = spark.createDataFrame([(1, line, "en", "s", 1, "a", 1, 0.5), (None, line, "en", None, 1, "b", 1, None), (2, None, None, "s", None, None, None, None)], schema)
    kept = corpus_pipeline.drop_repeated_lines(spark, docs, folder[0])
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 2}
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, folder[0])
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "None"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder[0]).count() == 0
