"""Language, repetition, licences and quality: brute force, held-out accuracy, awkward input."""

import random
import re

import numpy as np
from conftest_llm import CLASHES, prose, shown
import pytest
from pyspark.sql import functions as F

from maskwright.llm import gbquality, langid, licences, repetition


def test_repeat_words_equal_brute_force():
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc" if rng.random() < 0.5 else "ab") for _ in range(rng.randint(0, 150))) for _ in range(200)]
    for rules in (repetition.RepetitionRules(), repetition.RepetitionRules(batch_words=1)):
        for text, found in zip(texts, repetition.measure([t.encode() for t in texts], rules), strict=True):
            words, places = text.split(), {}
            for i in range(len(words) - 7):
                places.setdefault(tuple(words[i : i + 8]), []).append(i)
            inside = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
            assert found["n_repeat_words"] == len(inside)
            longest = max((k for k in range(len(words)) if len({tuple(words[i : i + k]) for i in range(len(words) - k + 1)}) <= len(words) - k), default=0)
            assert found["longest_repeat"] == (longest if longest >= 8 else 0)
            assert sum(s["last"] - s["first"] + 1 for s in found["repeat_spans"]) == len(inside)


def test_suffix_array_order():
    rng = np.random.default_rng(3)
    for n in (1, 2, 50, 300):
        symbols = np.r_[rng.integers(0, 3, n), 9]
        order, _ = repetition.suffix_array(symbols)
        assert sorted(order) == list(range(n + 1))
        shared = repetition.neighbour_prefixes(order, repetition.suffix_array(symbols)[1])
        for a, b, k in zip(order, order[1:], shared[1:], strict=False):
            assert list(symbols[a : a + k]) == list(symbols[b : b + k]) and symbols[a + k] != symbols[b + k]


def test_short_repeats_are_rejected():
    """Words said five times in a row, and short phrases between fresh words: no repeat has eight words."""
    fresh = prose(21, 400).split()
    in_a_row = " ".join(w for w in fresh[:12] for _ in range(5))
    phrases = " ".join(f"as we all know {w}" for w in fresh[:30])
    clean = " ".join([*fresh[:60], "as we all know", *fresh[60:90], "as we all know"])
    found = list(repetition.measure([t.encode() for t in (in_a_row, phrases, clean)], repetition.RepetitionRules()))
    assert [r["base_failed"] for r in found] == [False] * 3 and [r["n_repeat_words"] for r in found] == [0] * 3
    assert [r["kept"] for r in found] == [False, False, True]


def test_repetition_counts():
    text = "a#b $\u00a0c\n\nx y\nx y\n \nx y z"
    found = next(iter(repetition.measure([text.encode()], repetition.RepetitionRules())))
    assert (found["n_words"], found["word_chars"], found["n_symbols"], found["n_dup_lines"]) == (9, 13, 2, 1)


def test_repetition_awkward(awkward, nothing):
    rows = {(r["doc_id"], r["n_words"]): r for r in repetition.repetition(awkward).collect()}
    assert len(rows) < awkward.count() == repetition.repetition(awkward).count()
    assert rows[1, 0]["base_failed"] and not rows[1, 0]["kept"] and rows[2, 0]["n_dup_lines"] == 0
    assert rows[11, 400]["longest_repeat"] == 399 and not rows[11, 400]["kept"]
    assert rows[5, 30_000]["kept"] and rows[8, 100]["kept"]
    assert repetition.repetition(nothing).count() == 0
    kept = repetition.keep(awkward)
    assert kept.columns == awkward.columns and {5, 8, 9} <= {r["doc_id"] for r in kept.select("doc_id").collect()}


def test_language_accuracy(spark):
    rng = random.Random(2)
    parts = {"xx": "ta ko mi ru".split(), "yy": "sch ung ein ber".split(), "zz": "tion ment eau que".split()}
    make = lambda lang: " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(20))
    rows = [(i, lang, make(lang)) for i, lang in enumerate(list(parts) * 40)]
    model = langid.train(spark.createDataFrame(rows, "id long, lang string, text string"))
    fresh = list(parts) * 20
    found, score = langid.predict([make(lang) for lang in fresh], model)
    assert found == fresh and score.min() > 0.9


def test_language_scores_equal_plain_sum(spark):
    rows = [(1, "a", "abc abd"), (2, "b", "xyz"), (3, "b", None), (4, None, "abc")]
    settings = langid.LanguageSettings(bucket_bits=8)
    model = langid.train(spark.createDataFrame(rows, "id long, lang string, text string"), settings)
    assert model.languages == ("a", "b") and np.allclose(np.exp(model.log_prob).sum(0), 1)
    texts = ["abz!!xy", "b", ""]
    got, _ = langid.log_scores(texts, model)
    for text, row in zip(texts, got, strict=True):
        want = model.log_prior.copy()
        for bucket, _, _ in langid.ngrams([text], settings):
            for b in bucket:
                want = want + model.log_prob[b]
        assert np.allclose(row, want)


def test_language_awkward(awkward, nothing, spark):
    rows = [(i, "en" if i % 2 else "fr", prose(i, 30)) for i in range(20)]
    model = langid.train(spark.createDataFrame(rows, "id long, lang string, text string"))
    found = langid.identify(awkward, model, held_out=F.lit(True))
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"] and found.count() == awkward.count()
    by = {r["doc_id"]: r for r in found.collect()}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1, 2, 3, 6, 13)) and by[12]["lang_pred"] != "und"
    with pytest.raises(ValueError, match="more than 1 languages"):
        langid.train(spark.createDataFrame(rows, "id long, lang string, text string"), langid.LanguageSettings(most_languages=1))
    empty = langid.train(nothing.selectExpr("doc_id as id", "lang", "text"))
    assert {tuple(r)[1:] for r in langid.identify(awkward, empty).collect()} == {("und", 0.0)}
    assert langid.identify(nothing, model).count() == 0


def test_boosting_learns_and_walks_like_a_loop():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(3000, 5))
    labels = ((rows[:, 0] > 0) ^ (rows[:, 1] > 0.3)).astype(int)
    model = gbquality.fit(rows[:2000], labels[:2000], gbquality.BoostSettings(trees=40))
    assert ((model.score(rows[2000:]) > 0.5) == labels[2000:]).mean() > 0.95
    for row in rows[:20]:
        total = model.base
        for feature, cut, leaf in zip(model.feature, model.cut, model.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > cut[node])
            total += leaf[node - len(feature)]
        assert np.isclose(model.margin(row[None])[0], total)


def test_quality_awkward(awkward, nothing, spark):
    labels = spark.createDataFrame([(i, int(i > 110)) for i in range(100, 130)] + [(None, 1), (8, None), (100, 1)], "doc_id long, quality int")
    model = gbquality.train(awkward, labels.withColumns({c: F.lit(0) for c in CLASHES}))
    found = gbquality.classify(awkward, model, held_out=F.lit(False))
    assert found.count() == awkward.count() and found.filter("score is null or score < 0 or score > 1").count() == 0
    none = gbquality.train(awkward, labels.limit(0))
    assert {r["score"] for r in gbquality.classify(awkward, none).collect()} == {0.5}
    assert gbquality.classify(nothing, model).count() == 0


def test_licence_scan_equals_all_pairs():
    templates = licences.Templates()
    rng = random.Random(4)
    lines = []
    for _ in range(300):
        words = rng.choice(licences.TEMPLATES)[1].split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = prose(rng.randrange(99), 1)
        lines.append(" ".join(words[: rng.choice([len(words), 8])]))
    for line in lines:
        own = licences.bigrams(line)
        every = [(-licences.dice(own, licences.bigrams(t)), name) for name, t in licences.TEMPLATES]  # all pairs
        best = min(every)
        assert templates.best(own) == ((best[1], -best[0]) if -best[0] >= 0.8 else None)


def test_scan_equals_trying_every_part():
    """All lines, sentences, paragraphs and the whole text against all templates, without any test before."""
    templates, rng = licences.Templates(), random.Random(11)
    for _ in range(120):
        blocks = []
        for _ in range(rng.randint(1, 4)):
            own = rng.choice(licences.TEMPLATES)[1] if rng.random() < 0.6 else prose(rng.randrange(99), rng.choice([5, 60, 500]))
            blocks.append(re.sub(" ", lambda m: rng.choice(" \n") if rng.random() < 0.2 else " ", own))
        text = rng.choice(["\n\n", "\n", " "]).join(blocks)
        parts = {m.span() for m in licences.LINE.finditer(text)} | {m.span() for m in licences.PARAGRAPH.finditer(text)} | {(0, len(text))}
        for line in licences.LINE.finditer(text):
            parts |= {(line.start() + m.start(), line.start() + m.end()) for m in licences.SENTENCE.finditer(line.group())}
        want = set()
        for a, b in parts:
            own = licences.bigrams(text[a:b])
            score, name = min((-licences.dice(own, licences.bigrams(t)), n) for n, t in licences.TEMPLATES)
            if own and -score >= 0.8:
                want.add((name, a, b, -score))
        found, seen = templates.in_parts(text)
        assert {m for m in found if m[2] - m[1] < len(text)} == {m for m in want if m[2] - m[1] < len(text)}
        assert seen == licences.bigrams(text) & templates.any_bigram


def test_windows_equal_trying_every_window():
    """Damaged templates anywhere in prose, over line ends and blank lines, against the sets of every window of each template's length."""
    rng = random.Random(17)
    own = [(n, t) for n, t in licences.TEMPLATES if len(t) < 900]
    templates = licences.Templates(tuple(own))
    for _ in range(25):
        words = []
        for _ in range(rng.randint(1, 3)):
            words += prose(rng.randrange(10**6), rng.randint(0, 60)).split()
            body = rng.choice(own)[1].split()
            for _ in range(rng.choice([0, 0, 2, 12])):
                body[rng.randrange(len(body))] = prose(rng.randrange(99), 1)
            words += body
        text = "".join(w + rng.choice([" ", " ", " ", "\n", "\n\n", "\u0130 "]) for w in words)
        spans = [m.span() for m in licences.WORDS.finditer(licences.lowered(text))]
        low = [licences.lowered(text)[a:b] for a, b in spans]
        want = []
        for name, body in own:
            size, target = len(licences.WORDS.findall(body.lower())), licences.bigrams(body)
            for i in range(len(low) - size + 1):
                score = licences.dice(frozenset(zip(low[i : i + size], low[i + 1 : i + size], strict=False)), target)
                if score >= 0.8:
                    want.append((name, spans[i][0], spans[i + size - 1][1], score))
        assert sorted(templates.in_windows(text, templates.in_parts(text)[1])) == sorted(want)


def test_licences_inside_longer_texts():
    """The usual layout with blank lines between 60 lines of prose; a notice inside a line; one that is wrapped; a full text's notice."""
    templates, around = licences.Templates(), "\n".join(prose(i, 12) for i in range(60))
    body = licences.TEMPLATES[0][1]
    cut = [body.index("The above copyright"), body.index("THE SOFTWARE IS PROVIDED")]
    laid_out = "\n\n".join([body[: cut[0]].strip(), body[cut[0] : cut[1]].strip(), body[cut[1] :]])
    assert [(m[0], m[3]) for m in templates.scan(f"{around}\n\n{laid_out}\n\n{around}")] == [("MIT", 1.0)]
    flat = " ".join(body.split())
    assert [m[0] for m in templates.scan(f"{prose(1, 80)} {flat} {prose(2, 80)}")] == ["MIT"]
    for name, text in licences.TEMPLATES:
        wrapped = prose(3, 30) + "\n" + text.replace(" ", "\n", 3) + " " + prose(4, 30)
        assert name in {m[0] for m in templates.scan(wrapped)}, text
    assert templates.scan(around) == []


def test_licences_awkward(awkward, nothing, spark):
    assert licences.scan_licences(awkward).agg(F.sum("n_matches")).first()[0] == 0
    assert licences.scan_licences(nothing).count() == 0
    body = licences.TEMPLATES[0][1]
    text = f"{prose(1, 400)}\n\n{body[:500]}\n{body[500:]}\n\nfoo bar. All rights reserved. baz\nReleased under the MIT license"
    found = licences.scan_licences(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert found["licences"] == "MIT,all-rights-reserved" and found["score"] == 1.0 and found["n_matches"] == 3
    assert shown(licences.scan_licences(spark.createDataFrame([(None, None)], "doc_id long, text string"))) == [(None, 0, None, None, "", "")]
