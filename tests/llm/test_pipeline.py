"""The pipeline's stages on a small fixture of odd rows, each against brute force, and as a whole."""

import itertools
import re

import pytest

import corpus_pipeline
from marlspike.llm import catalog, packing, toxicity
from tests.llm.test_operators import least_reachable, shingle_set, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, sha string, kept string"
LABELS = "doc_id long, quality int, toxic int"
CLEAN, OTHER = words(81, 80), words(82, 300)
RUDE = " you horrid vile scum go away you horrid vile scum "


def rows():
    texts = [
        (1, CLEAN), (2, CLEAN.upper()), (3, CLEAN + " tail"), (4, None), (4, ""), (5, OTHER), (5, OTHER), (5, "other text under an id used before"),
        (None, "a text without an id"), (None, "a text without an id"), (None, CLEAN + " end"), (6, "lead " + OTHER[:400]), (7, words(83, 9000)), (8, " "), (9, "one"), (10, "One"),
        (11, "é" * 150), (12, "x" + "é" * 150), (13, OTHER[100:500] + RUDE * 30), (14, RUDE * 40),
    ]
    for k in range(100, 180):
        texts.append((k, words(900 + k, 40) + (RUDE * 3 if k % 3 == 0 else "")))
    return [(i, t, "en", "s", None if t is None else len(t), k, "clash", "clash") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(rows(), SCHEMA).repartition(4).write.parquet(f"{folder}/documents.parquet")
    labels = [(k, 1, int(k % 3 == 0)) for k in range(100, 180)] + [(14, 0, 1), (None, 1, 1), (1, 1, None), (100, 1, 0)]
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_catalogue_has_each_operator():
    assert [sum(n.startswith(f"op{k}_") for n in catalog.QUERIES) for k in range(1, 11)] == [1] * 10
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "suffix dedup", "packing"]


def plain(df):
    return sorted(map(tuple, df.select(corpus_pipeline.COLUMNS).collect()), key=str)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def no_id_last(r):
    return (r[0] is None, r[0] or 0)


def exact(held):
    """Of equal texts the largest id stays; null ids are the smallest."""
    best = {}
    for r in held:
        key = lowered(r[1])
        if key not in best or (r[0] is not None, r[0] or 0) > (best[key][0] is not None, best[key][0] or 0):
            best[key] = r
    return list(best.values())


def near(held):
    sets = {k: shingle_set(r[1], 5) for k, r in enumerate(held)}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    label = least_reachable(sets, links)
    first = {}
    for k, r in enumerate(held):
        if label[k] not in first or no_id_last(r) < no_id_last(held[first[label[k]]]):
            first[label[k]] = k
    return [held[k] for k in first.values()]


def suffix(held):
    seen, out = set(), []
    for r in sorted(held, key=no_id_last):
        raw = (r[1] or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - 99):
            w = raw[i : i + 100]
            if w in seen:
                gone[i : i + 100] = [True] * 100
            seen.add(w)
        text, at = "", 0
        for c in r[1] or "":
            n = len(c.encode())
            text += "" if all(gone[at : at + n]) else c
            at += n
        out.append((r[0], None if r[1] is None else text, *r[2:4], len(text) if any(gone) else r[4]))
    return out


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first, second, third, fourth, last = (stage for _, stage in corpus_pipeline.STAGES)
    clean = first(spark, docs, sf_dir).cache()
    model = toxicity.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    gone = [r["doc_id"] for r in toxicity.score(docs, model, "row").collect() if r["predicted"]]
    assert clean.columns == corpus_pipeline.COLUMNS
    assert plain(clean) == plain(docs.filter(~docs.row.isin(gone)))
    texts = [r[1] or "" for r in rows()]
    assert {k for k, t in enumerate(texts) if t.count("vile") > 3} <= set(gone) and len(gone) < len(texts) / 2
    for stage, rule in ((second, exact), (third, near), (fourth, suffix)):
        out = stage(spark, clean, sf_dir).cache()
        assert out.columns == corpus_pipeline.COLUMNS
        assert plain(out) == sorted(rule([tuple(r) for r in clean.collect()]), key=str), stage.__name__
        clean = out
    encode = packing.token_ids(packing.TOKENIZER).whole
    packed = last(spark, clean, sf_dir).collect()
    need = sum(len(encode.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in clean.collect())
    fill = {}
    for r in packed:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert sum(fill.values()) == need and max(fill.values()) <= 1024
    # the stages one after another, through written tables, are the pipeline
    assert sorted((str(r["doc_id"]), r["piece"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted((str(r["doc_id"]), r["piece"], r["ids_crc32"]) for r in packed)


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_on_the_smallest_tables(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir).cache()
        assert out.columns == corpus_pipeline.COLUMNS
        seen.append((docs.count(), out.count()))
        docs = out
    assert all(after <= before for before, after in seen)
    assert seen[1][1] < seen[1][0] and seen[2][1] < seen[2][0]
    assert seen[3][0] == seen[3][1]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert packed.groupBy("sequence_id").sum("length").filter("`sum(length)` > 1024").count() == 0
