"""The pipeline's stages on a small corpus, each judged on its own input."""

import random
import re

import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    item = words(rng, 30) + ". " + words(rng, 12) + "."
    passage = words(rng, 90)
    own = {k: words(rng, 120) for k in range(12)}
    own[20] = own[3]
    near = own[4].split()
    near[50] = "changed"
    own[21] = " ".join(near)
    own[22] = f"{words(rng, 40)} {item} {words(rng, 40)}"
    own[23] = f"{words(rng, 40)} {passage} {words(rng, 40)}"
    own[24] = f"{words(rng, 50)} {passage} {words(rng, 30)}"
    own[25] = "too short"
    own[26] = None
    rows = [(k, t, "en", "s", len(t or "")) for k, t in own.items()] + [(5, own[5], "en", "s", len(own[5])), (None, own[6] + " more", None, None, None)]
    d = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(12)], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    return str(d), own, passage


def test_stages(spark, corpus, tmp_path):
    d, own, passage = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = seen[name] = spark.read.parquet(str(tmp_path / name))
    ids = lambda name: sorted((r.doc_id for r in seen[name].select("doc_id").collect()), key=str)
    assert ids("quality_rules") == sorted([*range(12), 5, 20, 21, 22, 23, 24, None], key=str)
    # the copy and the near copies go, also that without an id, and the repeated row stays once
    assert ids("near_dedup") == [*sorted([*range(12), 22, 23, 24], key=str)]
    texts = {r.doc_id: r.text for r in seen["suffix_array_dedup"].collect()}
    assert passage not in texts[23] + texts[24] and len(texts[23]) < len(own[23]) - 300 and texts[0] == own[0] and texts[22] == own[22]
    assert 22 not in ids("benchmark_decontamination") and len(ids("benchmark_decontamination")) == len(ids("suffix_array_dedup")) - 1
    packed = seen["pack"].collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in seen["benchmark_decontamination"].collect()}
    by_text = {r.doc_id: r.text for r in seen["benchmark_decontamination"].collect()}
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(corpus_pipeline.vocabulary())
    for i, t in by_text.items():
        assert sum(r.length for r in packed if r.doc_id == i) == len(tokenizer.encode(t, add_special_tokens=False).ids) + 1


def test_run_chains_the_stages(spark, corpus):
    d, _, _ = corpus
    found = corpus_pipeline.run(spark, d)
    assert found.where("doc_id = 22").isEmpty() and found.select("doc_id").distinct().count() == 14


def test_rows_are_judged_by_themselves(spark, corpus):
    """Ids that name several texts, rows without ids, extra columns with the names used inside."""
    d, _, _ = corpus
    rng = random.Random(17)
    a, b, c = words(rng, 100), words(rng, 100), words(rng, 100)
    rows = [(1, a), (1, b), (1, "too short"), (1, None), (None, c), (None, "bad"), (None, c), (7, c), (8, a), (1, a), (9, None), (None, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", 0, n, 5, 6) for n, (k, t) in enumerate(rows)], f"{COLUMNS}, _row long, id long, h long")
    good = corpus_pipeline.quality_rules(spark, docs, d)
    assert good.columns == docs.columns
    assert sorted(r._row for r in good.collect()) == [0, 1, 4, 6, 7, 8, 9]
    once = corpus_pipeline.near_dedup(spark, docs, d)
    assert once.columns == docs.columns
    found = once.collect()
    assert sorted((str(r.doc_id), r.text) for r in found if r.text and len(r.text) > 20) == sorted([("1", a), ("1", b), ("7", c)])
    assert sum(r.text is None for r in found) == 3 and len(found) == 3 + 3 + 2
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), d)
        assert out.count() == 0 and (name == "pack" or out.columns == docs.columns), name
    for name, stage in corpus_pipeline.STAGES[2:4]:
        assert stage(spark, docs, d).count() == len(rows), name


def test_spans_and_characters():
    from loamstone.llm import suffix_dedup

    assert suffix_dedup.merged([5, 0, 2], [9, 2, 4]) == [(0, 4), (5, 9)] and suffix_dedup.merged(None, None) == []
    assert re.sub("b", "", "abc") == suffix_dedup._without(b"abc", [(1, 2)]).decode()


def test_passages_of_51_short_words_are_cut(spark):
    """51 words go, whatever their bytes and the white space between them; 50 words of under 300 bytes stay."""
    rng = random.Random(5)
    short = lambda n: ["".join(rng.choice("abcdefghijklmnopé") for _ in range(rng.randint(1, 3))) for _ in range(n)]
    tiny, fifty = short(51), short(50)
    letters = [chr(97 + k % 26) for k in range(26)] + [chr(65 + k % 25) for k in range(25)]
    assert len(" ".join(tiny).encode()) < 300 and len(" ".join(letters)) == 101
    own = {k: words(rng, 60) for k in range(8)}
    rows = [
        (0, f"{own[0]} {' '.join(tiny)} {own[1]}"), (1, f"{own[2]} {' '.join(tiny[:20])}\n{' '.join(tiny[20:])} {own[3]}"), (2, f"{own[4]} {' '.join(letters)}"),
        (None, f"{' '.join(letters)} {own[5]}"), (4, f"{own[6]} {' '.join(fifty)}"), (5, f"{' '.join(fifty)} {own[7]}"), (6, None), (7, ""),
    ]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], COLUMNS).repartition(3)
    found = {r.doc_id: r for r in corpus_pipeline.suffix_array_dedup(spark, docs, "").collect()}
    wanted = {0: f"{own[0]}  {own[1]}", 1: f"{own[2]}  {own[3]}", 2: f"{own[4]} ", None: f" {own[5]}", 4: rows[4][1], 5: rows[5][1], 6: None, 7: ""}
    assert {k: r.text for k, r in found.items()} == wanted
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in found.values())


@pytest.mark.parametrize("seed", range(2))
def test_repeated_words_against_brute_force(spark, seed):
    from loamstone.llm import suffix_dedup

    rng = random.Random(seed)
    base = [rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(700)]
    texts = []
    for _ in range(25):
        t = base[rng.randint(0, 400) : rng.randint(410, 700)]
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(len(t))] = f"n{rng.randint(0, 9)}"
        texts.append(t)
    texts.append(["a", "b"] * 60)
    seen = {}
    for k, t in enumerate(texts):
        for p in range(len(t) - 50):
            seen.setdefault(tuple(t[p : p + 51]), []).append((k, p))
    wanted = {}
    for places in seen.values():
        for k, p in places if len(places) > 1 else []:
            wanted.setdefault(k, set()).update(range(p, p + 51))
    docs = spark.createDataFrame([(k, " \n"[k % 2].join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    found = {r.id: {x for s, e in zip(r.starts, r.ends) for x in range(s, e)} for r in suffix_dedup.repeated_spans(docs, window=51, words=True).collect()}
    assert found == wanted


def test_digest_tells_of_passages_of_few_bytes(spark):
    """51 words of under 400 bytes: no byte counts as removed by the window, but the words are counted and cut; the other columns are those without words."""
    from loamstone.llm import suffix_dedup

    rng = random.Random(9)
    passage, long = words(rng, 51), words(rng, 120)
    own = {k: words(rng, 60) for k in range(6)}
    assert len(passage.encode()) < 400 < len(long.encode())
    rows = [(0, f"{own[0]} {passage} {own[1]}"), (1, f"{passage} {own[2]}"), (2, f"{own[3]}\n{long}"), (None, f"{long}\n{own[4]}"), (4, own[5]), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: r for r in suffix_dedup.repeat_digest(docs, words=51).collect()}
    plain = {r.doc_id: r for r in suffix_dedup.repeat_digest(docs).collect()}
    assert {k: tuple(r)[:5] for k, r in found.items()} == {k: tuple(r) for k, r in plain.items()}
    assert [found[k].n_removed > 0 for k in (0, 1, 2, None, 4, 5, 6)] == [False, False, True, True, False, False, False]
    assert [found[k].n_passage_words for k in (0, 1, 2, None, 4, 5, 6)] == [51, 51, 120, 120, 0, 0, 0]
    assert found[0].text == f"{own[0]}  {own[1]}" and found[1].text == f" {own[2]}"
    assert (found[4].text, found[5].text, found[6].text) == (own[5], None, "")
    kept = {r.doc_id: r.text for r in suffix_dedup.without_repeats(docs, words=51).collect()}
    assert {k: r.text for k, r in found.items()} == kept
