"""The pipeline and its stages on a small table with nulls, empty and long texts, repeats, ties and clashing names."""

import collections
import re
import zlib

import numpy as np
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = "lang_pred string, score string, __raw string, `__loc` string, id int, c0 int, `_metadata` string, n int"


def corpus():
    r = np.random.default_rng(11)
    sound = {"en": ["the", "of", "and", "with", "house", "water", "light", "stone"], "fr": ["le", "été", "à", "maison", "eau", "lumière", "déjà", "pierre"]}
    text = lambda lang, n: " ".join(str(w) + str(x) for w, x in zip(r.choice(sound[lang], n), r.choice(list("abcdefghij"), n)))
    texts = [(text(lang, int(n)), lang) for n, lang in zip(r.integers(5, 60, 50), ["en", "fr"] * 25)]
    near = [(" ".join([*t.split()[:-1], "changed"]), lang) for t, lang in texts if len(t.split()) > 40]
    long = (" ".join(text("en", 5000) for _ in range(40)), "en")
    texts += near + texts[:6] + [long, long, (None, "en"), ("", "fr"), (" \n\t", None), ("½ 12 !", "en"), (texts[0][0], None)]
    return [(i if i % 17 else None if i == 17 else i, t, lang, ["s1", "s2", None][i % 3], len(t or ""), "p", "q", "r", "s", 1, 2, "m", 3) for i, (t, lang) in enumerate(texts)]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + EXTRA


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pipe"))
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder, rows


def texts(df):
    return collections.Counter(r["text"] for r in df.collect())


def test_stages_in_order(spark, table):
    import corpus_pipeline as P

    folder, rows = table
    assert [n for n, _ in P.STAGES] == ["language", "exact_dedup", "near_dedup", "mix", "pack"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = P.saved(P.language(spark, docs, folder))
    assert kept.columns == docs.columns and all(r["score"] == "q" and r["lang_pred"] == "p" and r["__loc"] == "s" and r["_metadata"] == "m" for r in kept.collect())
    left = texts(kept)
    assert not any(t is None or not any(c.isalpha() for c in t) for t in left)
    assert sum(left.values()) >= 0.95 * sum(t is not None and any(c.isalpha() for c in t) for _, t, *_ in rows)

    once = P.saved(P.exact(spark, kept, folder))
    best = {}
    for r in kept.collect():
        best[r["text"]] = max(best.get(r["text"], -1), -1 if r["doc_id"] is None else r["doc_id"])
    assert once.columns == docs.columns and {r["text"]: -1 if r["doc_id"] is None else r["doc_id"] for r in once.collect()} == best and once.count() == len(best)

    apart = P.saved(P.near(spark, once, folder))
    mine = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["text"]) for r in once.collect())
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} for w in (WORD.findall(t.lower()) for _, t in mine)]
    group = list(range(len(mine)))
    for i in range(len(mine)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 70 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    assert apart.columns == docs.columns and texts(apart) == collections.Counter(mine[g][1] for g in set(group)) and len(set(group)) < len(mine)

    mixed = P.saved(P.mix(spark, apart, folder))
    assert mixed.columns == docs.columns and set(texts(mixed)) <= set(texts(apart)) and max(texts(mixed).values()) <= 2

    from palimpsest.llm.tokens import load

    tok = load(P.public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter(zlib.crc32(np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for t in texts(mixed).elements())
    pieces = P.packing(spark, mixed, folder).collect()
    assert sum(p["length"] for p in pieces) == sum(len(tok.encode(t, add_special_tokens=False).ids) + 1 for t in texts(mixed).elements())
    assert not {p["ids_crc32"] for p in pieces if p["length"] == p["doc_tokens"]} - set(want)
    out = P.run(spark, folder)
    assert out.columns == P.packing(spark, mixed, folder).columns and out.agg({"length": "sum"}).first()[0] == sum(p["length"] for p in pieces)


def test_empty_table_and_unwritten_frames(spark, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
    docs = spark.createDataFrame([(1, "same words here"), (2, "same words here"), (3, "other words there")], "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in P.exact(spark, docs, "").collect()) == [2, 3]
    assert sorted(r["doc_id"] for r in P.near(spark, docs, "").collect()) == [1, 3]
