"""SimHash, personal data, packing, mixing, sentence spans, vectors and the pipeline."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from conftest_llm import prose, shown
from pyspark.sql import functions as F

from maskwright.llm import lengthpack, mixture, permindex, pii_lstm, runindex, sentspan, simhash


def roots(n: int, links: list[tuple[int, int]]) -> list[int]:
    own = list(range(n))
    for _ in range(n):
        for a, b in links:
            own[a] = own[b] = min(own[a], own[b])
    return own


def test_fingerprint_equals_definition():
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 60):
        text = "  \t".join(rng.choice(["Ab", "c", "É", "dd"]) for _ in range(n))
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0
        assert simhash.fingerprint(text.encode()) == want


def test_gray_index_equals_all_pairs():
    rng = np.random.default_rng(7)
    for _ in range(40):
        n, base = int(rng.integers(1, 300)), rng.integers(0, 2**63, 15).astype(np.uint64)
        values = base[rng.integers(0, 15, n)]
        for _ in range(int(rng.integers(0, 12))):
            values = np.where(rng.random(n) < 0.4, values ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)), values)
        values = np.unique(values)
        index = simhash.GrayIndex(rng.integers(0, 3, len(values)), values, int(rng.integers(2, 9)))
        links = [(a, b) for a, b in combinations(range(len(values)), 2) if index.cells[a] == index.cells[b] and int(index.values[a] ^ index.values[b]).bit_count() <= 4]
        assert index.components(4, int(rng.integers(1, 400))).tolist() == roots(len(values), links)


def test_choices_lose_no_link():
    rng = random.Random(3)
    for distinct in (10, 10**7, 10**9, 10**12):
        masks = simhash.choices(distinct, 4, 512)
        for _ in range(200):
            flips = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(flips & m == 0 for m in masks)


@pytest.mark.parametrize("block", [4, 256])
def test_near_duplicates_equal_all_pairs(spark, block):
    rng = random.Random(block)
    rows, i = [], 0
    for seed in range(12):
        words = prose(seed, 150).split()
        for _ in range(rng.choice([1, 5, 25])):
            own = list(words)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(150)] = prose(rng.randrange(10**6), 1)
            rows.append((i := i + 1, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in simhash.near_duplicates(docs, simhash.SimHashSettings(least_block=block)).collect()}
    prints = [simhash.fingerprint(t.encode()) for _, t in rows]
    own = roots(len(rows), [(a, b) for a, b in combinations(range(len(rows)), 2) if (prints[a] ^ prints[b]).bit_count() <= 4])
    assert [found[d]["component_id"] for d, _ in rows] == [rows[o][0] for o in own]
    kept = simhash.one_of_each(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({rows[o][0] for o in own})


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    found = dict(shown(simhash.components(spark.createDataFrame(links, "u long, v long"))))
    assert found == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)}


def test_simhash_awkward(awkward, nothing):
    found = simhash.near_duplicates(awkward)
    assert found.count() == awkward.count() and simhash.near_duplicates(nothing).count() == 0
    by = {r["doc_id"]: r for r in found.collect()}
    assert by[1]["fp"] == 0 and by[1]["component_id"] == by[3]["component_id"] == 1 and by[9]["component_id"] == 8
    kept = [r["doc_id"] for r in simhash.one_of_each(awkward).collect()]
    assert simhash.one_of_each(awkward).columns == awkward.columns
    assert kept.count(10) == 2 and 9 not in kept and kept.count(None) == 2 and not {1, 2, 3} & set(kept)


def brute_spans(text: str) -> list:
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and pii_lstm.luhn(digits(m))]
    return found + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]


def test_patterns_equal_plain_search():
    rng = random.Random(8)
    for _ in range(20_000):
        text = "".join(rng.choice("0123456789..@@ab+- ()é_\n") for _ in range(rng.randint(0, 40)))
        assert pii_lstm.base_spans(text) == brute_spans(text)


def test_gradient_equals_differences():
    tagger, rng = pii_lstm.Tagger(3, 1), np.random.default_rng(0)
    x, y = rng.integers(0, pii_lstm.SIGNS, (7, 4)), rng.integers(0, 6, (7, 4))
    _, grad = tagger.gradient(x, y)
    for name, value in tagger.p.items():
        at = (x[3, 2], 2) if "sign" in name else tuple(0 for _ in value.shape)
        value[at] += 1e-5
        up, _ = tagger.gradient(x, y)
        value[at] -= 2e-5
        down, _ = tagger.gradient(x, y)
        value[at] += 1e-5
        assert abs((up - down) / 2e-5 / len(x) - grad[name][at]) < 1e-6


def test_scores_decoding_and_pruning_equal_brute_force():
    tagger, rng = pii_lstm.Tagger(4, 2), np.random.default_rng(3)
    x = rng.integers(0, pii_lstm.SIGNS, (5, 30)).astype(np.uint8)
    sizes = np.full(30, 5)
    e = tagger.scores(x, sizes)
    ahead, back = tagger._run(x, "f"), tagger._run(x[::-1], "b")
    h = np.concatenate([np.stack([s[5] for s in ahead]), np.stack([s[5] for s in back])[::-1]], 2)
    assert np.allclose(e.transpose(0, 2, 1), h @ tagger.p["out"] + tagger.p["bias"], atol=1e-4)
    tagger.p["move"] = rng.normal(0, 0.5, (6, 6))
    for shift in (0, 3.0):
        e[:, 0] += shift
        paths, open_ = tagger.decode(e, sizes), set(tagger.open_windows(e, sizes))
        for w in range(30):
            every = np.array(np.meshgrid(*[range(6)] * 5, indexing="ij")).reshape(5, -1)
            total = sum(e[t, every[t], w] for t in range(5)) + sum(tagger.p["move"][every[t - 1], every[t]] for t in range(1, 5))
            assert paths[:, w].tolist() == every[:, total.argmax()].tolist()
            assert w in open_ or not every[:, total.argmax()].any()


def test_spans_at_a_window_start_are_not_pruned():
    """A label that is slow to enter but is ahead from the first character on: nothing enters it there."""
    tagger = pii_lstm.Tagger(4, 2)
    tagger.p["move"] = np.full((6, 6), -1.2)
    tagger.p["move"][np.diag_indices(6)] = (2.31, 1.99, 2.16, 2.2, 2.29, 1.81)
    e = np.zeros((12, 6, 2), np.float32)
    e[:, 1, 0] = 0.45
    sizes = np.array([12, 12])
    assert (tagger.decode(e, sizes)[:, 0] == 1).all() and tagger.open_windows(e, sizes).tolist() == [0]


def test_windows_do_not_depend_on_their_neighbours():
    tagger, rng = pii_lstm.default_tagger(), random.Random(5)
    texts, _ = pii_lstm.labelled_examples(80, 96, 3)
    texts = [t[: rng.randint(0, 96)] for t in texts]
    for own, alone in zip(pii_lstm.tag(texts, tagger), texts, strict=True):
        assert own == pii_lstm.tag([alone], tagger)[0]
    sizes = np.sort(rng.choices(range(1, 40), k=20))
    x = np.random.default_rng(1).integers(0, pii_lstm.SIGNS, (int(sizes[-1]), 20)).astype(np.uint8)
    together = tagger.scores(x, sizes)
    for w, n in enumerate(sizes):
        one = tagger.scores(x[:n, w : w + 1], np.array([n]))
        assert np.allclose(one[:, :, 0], together[:n, :, w], atol=1e-4)


def test_kept_weights_are_those_of_the_training():
    kept = pii_lstm.default_tagger()
    assert pii_lstm.WEIGHTS.exists() and kept.p["move"].shape == (6, 6)
    short = pii_lstm.TagSettings(steps=60)
    texts, spans = pii_lstm.labelled_examples(400, short.length, short.seed)
    losses = []
    for tagger in (pii_lstm.Tagger(short.units, short.seed), pii_lstm.fit(texts, spans, short), kept):
        x = np.stack([np.r_[pii_lstm.encode(t), np.full(short.length - len(t), pii_lstm.NEWLINE, np.uint8)] for t in texts[:64]])
        y = np.zeros(x.shape, np.int64)
        for i, own in enumerate(spans[:64]):
            for kind, a, b in own:
                y[i, a:b] = pii_lstm.LABELS.index(kind)
        losses.append(tagger.gradient(x.T, y.T)[0])
    assert losses[0] > losses[1] > losses[2]


def test_tagger_finds_held_out_spans():
    settings = pii_lstm.TagSettings()
    tagger = pii_lstm.default_tagger()
    texts, spans = pii_lstm.labelled_examples(300, 96, 99)
    found = pii_lstm.tag(texts, tagger, settings)
    right = sum(len(set(a) & set(b)) for a, b in zip(spans, found, strict=True))
    assert right > 0.95 * sum(map(len, spans)) and right > 0.95 * sum(map(len, found))
    clean, mail = prose(1, 400), "jo.do77@mail.example.org"
    for at in range(400, 560, 7):  # over the borders of windows
        text = clean[:at] + f" {mail} " + clean[at:]
        assert ("email", at + 1, at + 1 + len(mail)) in pii_lstm.tag([text], tagger, settings)[0]


def test_personal_data_awkward(awkward, nothing, spark):
    tagger = pii_lstm.default_tagger()
    found = pii_lstm.personal_data(awkward, tagger)
    by = {r["doc_id"]: r for r in found.collect()}
    assert found.count() == awkward.count() and by[1]["spans"] == "" and pii_lstm.personal_data(nothing, tagger).count() == 0
    assert [by[14][k] for k in ("n_email", "n_ip", "n_card", "n_phone")] == [1, 1, 1, 1]
    clean = pii_lstm.redact(awkward, tagger)
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert clean.columns == awkward.columns and texts[1] is None and texts[14] == "[EMAIL] [IP] card [CARD] [PHONE]"
    assert pii_lstm.redacted("abcdef", [("email", 1, 3), ("ip", 2, 4), ("card", 4, 5)]) == "a[EMAIL][CARD]f"


def test_running_sum_and_permutation(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 0, 0, 1, 2]), rng.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "i long, g long, a long")
    found = runindex.running_sum(df, 3000, "g", "a", ["i"], "before", lane_rows=64).collect()
    for g in (0, 1, 2):
        own = sorted((r["before"], r["before"] + r["a"]) for r in found if r["g"] == g)
        assert own[0][0] == 0 and all(x[1] == y[0] for x, y in zip(own, own[1:], strict=False))
    for n in (1, 2, 17, 1000):
        df = spark.range(n).withColumn("n", F.lit(n).cast("long"))
        assert sorted(r[0] for r in runindex.permuted(df, "id", "n", [], "to").select("to").collect()) == list(range(n))


def filled(sizes: list[int]) -> list[float]:
    """Targets by repeated resharing."""
    left, capped, got = float(sum(sizes)), set(), [0.0] * len(sizes)
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        weight = sum(i % 3 + 1 for i in free)
        for i in free:
            got[i] = left * (i % 3 + 1) / weight
        over = [i for i in free if got[i] > 3 * sizes[i]]
        if not over:
            return got
        for i in over:
            capped.add(i)
            got[i] = 3.0 * sizes[i]
            left -= got[i]


def test_targets_equal_resharing(spark):
    rng = random.Random(2)
    for _ in range(6):
        sizes = [rng.choice([0, 1, 5, 50, 1000]) for _ in range(rng.randint(1, 9))]
        df = spark.createDataFrame([(chr(97 + i), s) for i, s in enumerate(sizes)], "source string, source_size long")
        found = {r["source"]: r["target"] for r in mixture.targets(df, 3).collect()}
        if sum(sizes):
            assert np.allclose([found[chr(97 + i)] for i in range(len(sizes))], filled(sizes))


def test_mix_takes_its_targets_and_reruns_agree(spark):
    rows = [(i, prose(i, 20 + i % 150), "en", f"s{min(i % 9, 4)}", 0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = mixture.mix(docs)
    found = mixture.taken_words(mixed).collect()
    again = mixture.taken_words(mixture.mix(docs.repartition(7))).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again)) and len(found) == 400
    sums: dict[tuple, int] = {}
    for r in found:
        assert r["taken"] <= 3 * r["size"]
        key = (rows[r["doc_id"]][3], r["target"])
        sums[key] = sums.get(key, 0) + r["taken"]
    assert len(sums) == 5 and all(abs(taken - target) <= 64 + 0.01 * target for (_, target), taken in sums.items())
    texts = dict((r[0], r[1]) for r in rows)
    pieces: dict[int, int] = {}
    for r in mixture.mixed_documents(docs, mixed).collect():
        assert r["text"].strip() in texts[r["doc_id"]]
        pieces[r["doc_id"]] = pieces.get(r["doc_id"], 0) + len(r["text"].split())
    assert all(pieces.get(r["doc_id"], 0) == r["taken"] for r in found)
    shards = mixed.taken.select("shard", "slot", "sid", "epoch", "block").distinct()
    assert shards.count() == shards.select("shard", "slot").distinct().count() == shards.select("sid", "epoch", "block").distinct().count()


def test_draws_are_multinomial_and_settled(spark):
    """Shards' counts of sources against a multinomial draw, and every source's number of slots against its quota."""
    quotas = [5000, 3000, 1500, 400, 100, 0]
    rows = [(i + 1, max(1, q // 2), q, sum(quotas[:i])) for i, q in enumerate(quotas)]
    sources = spark.createDataFrame(rows, "sid long, blocks long, quota long, first_slot long")
    settings = mixture.MixSettings(shard_slots=200, chunk=512)
    found = mixture.drawn(sources, sum(quotas), len(quotas), settings).collect()
    again = mixture.drawn(sources.repartition(3), sum(quotas), len(quotas), settings).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))
    assert len({(r["shard"], r["slot"]) for r in found}) == len(found) == 10_000 and len({(r["sid"], r["epoch"], r["block"]) for r in found}) == 10_000
    assert [sum(r["sid"] == i + 1 for r in found) for i in range(6)] == quotas
    for i, q in enumerate(quotas[:4]):
        counts = np.bincount([r["shard"] for r in found if r["sid"] == i + 1], minlength=50)
        share = q / 10_000
        assert 0.5 < counts.var() / (200 * share * (1 - share)) < 1.6


def test_mix_awkward(awkward, nothing):
    mixed = mixture.mix(awkward)
    found = mixture.taken_words(mixed).collect()
    assert len(found) == awkward.count() and all(r["taken"] <= 3 * r["size"] and r["target"] is not None for r in found)
    assert all(r["size"] == r["taken"] == 0 for r in found if r["doc_id"] in (1, 2, 3))
    out = mixture.mixed_documents(awkward, mixed)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert out.select(F.sum(F.regexp_count("text", F.lit(mixture.WORD)))).first()[0] == sum(r["taken"] for r in found)
    empty = mixture.mix(nothing)
    assert mixture.taken_words(empty).count() == 0 and mixture.mixed_documents(nothing, empty).count() == 0


def test_boundaries_are_the_best():
    rng = random.Random(6)
    for _ in range(60):
        histogram = {rng.randint(1, 30): rng.randint(1, 9) for _ in range(rng.randint(1, 8))}
        cost = lambda bounds: sum(c * (min(b for b in bounds if b >= n) - n) for n, c in histogram.items())  # noqa: E731, B023
        for k in (1, 2, 3):
            most = max(histogram)
            best = min(cost([*own, most]) for m in range(k) for own in combinations(sorted(set(histogram) - {most}), min(m, len(histogram) - 1)))
            found = lengthpack.boundaries(histogram, k)
            assert len(found) <= k and cost(found) == best
    assert lengthpack.boundaries({0: 5}, 3) == []


def test_packing_awkward(awkward, nothing):
    settings = lengthpack.PackSettings(max_words=512, buckets=4, budget_words=2048)
    rows = lengthpack.pack(awkward, settings).collect()
    assert sum(r["n_words"] for r in rows) == sum(len(re.findall(mixture.WORD, t or "")) for t in (r["text"] for r in awkward.collect()))
    assert all((r["bucket"] is None) == (r["n_words"] == 0) for r in rows)
    batches: dict[tuple, list] = {}
    for r in rows:
        if r["bucket"]:
            assert 0 <= r["padding"] == r["bucket"] - r["n_words"]
            batches.setdefault((r["bucket"], r["batch"]), []).append(r["place"])
    for (bucket, _), places in batches.items():
        assert sorted(places) == list(range(len(places))) and len(places) * bucket <= 2048
    assert lengthpack.pack(nothing, settings).count() == 0


def test_spans_equal_plain_loop(spark):
    rng = random.Random(9)
    pool = [prose(i, 7).replace(".", "") + "." for i in range(30)] + [prose(50, 40).replace(".", "")]
    rows = [(i, rng.choice(["\n", " "]).join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(120)]
    settings = sentspan.SpanSettings()
    found = {r["doc_id"]: r for r in sentspan.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    seen: set = set()
    for i, text in rows:
        pieces = [" ".join(x.decode() for x in p) for line in text.encode().split(b"\n") for p in sentspan.line_pieces(line, settings.longest)]
        gone = set()
        for a in range(len(pieces) - 2):
            if (run := tuple(pieces[a : a + 3])) in seen:
                gone |= {a, a + 1, a + 2}
            seen.add(run)
        assert found[i]["n_removed"] == len(gone) and found[i]["n_pieces"] == len(pieces)
        assert found[i]["text"].split() == " ".join(p for k, p in enumerate(pieces) if k not in gone).split()


def test_spliced_passages_equal_all_windows(spark):
    """Passages of 51 words or more spliced into sentences: every word of a window that came before goes, also without runs."""
    rng, fresh = random.Random(12), iter(range(10_000, 20_000))
    pool = [prose(300 + i, rng.choice([51, 60, 90])).replace(".", "") for i in range(6)]
    rows = []
    for i in range(60):
        parts = [prose(next(fresh), rng.randint(1, 40)).replace(".", rng.choice(["", "."])) + rng.choice([" ", "\n"]) + rng.choice(pool) for _ in range(rng.randint(0, 3))]
        rows.append((i, " ".join([*parts, prose(next(fresh), 5)])))
    found = {r["doc_id"]: r for r in sentspan.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    windows: set = set()
    runs: set = set()
    lost = alone = 0
    for i, text in rows:
        words, gone, by_run = text.split(), set(), set()
        sizes = [len(p) for line in text.encode().split(b"\n") for p in sentspan.line_pieces(line, 16)]
        starts = [sum(sizes[:k]) for k in range(len(sizes) + 1)]
        for k in range(len(sizes) - 2):
            if (run := tuple(" ".join(words[starts[j] : starts[j + 1]]) for j in range(k, k + 3))) in runs:
                by_run |= set(range(starts[k], starts[k + 3]))
            runs.add(run)
        for k in range(len(words) - 50):
            if (window := tuple(words[k : k + 51])) in windows:
                gone |= set(range(k, k + 51))
            windows.add(window)
        assert found[i]["text"].split() == [w for k, w in enumerate(words) if k not in gone | by_run]
        assert found[i]["n_removed"] == sum(any(k in gone | by_run for k in range(a, b)) for a, b in zip(starts, starts[1:], strict=False))
        lost, alone = lost + len(gone), alone + len(gone - by_run)
    assert lost > 1000 and alone > 100


def test_spans_awkward(awkward, nothing):
    found = sentspan.remove_repeats(awkward)
    assert found.count() == awkward.count() and sentspan.remove_repeats(nothing).count() == 0
    by = {}
    for r in found.collect():
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["text"] is None and by[2][0]["n_pieces"] == 0 and by[8][0]["n_removed"] == 0
    assert by[9][0]["n_removed"] == by[9][0]["n_pieces"] and sorted(r["n_removed"] for r in by[10]) == [0, 0, 0]


@pytest.mark.parametrize("spread", [0.0, 0.5, 1.0])
def test_search_recall_by_inner_product(spark, spread):
    """Vectors of one norm, and of log-normal norms, in one block: the index chooses 30 % of it for each query."""
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(4000, 32))
    vectors *= np.exp(rng.normal(0, spread, (4000, 1))) / np.linalg.norm(vectors, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = permindex.search(df, F.col("vec_id") % 20 == 0, 20).toPandas()
    hits = 0
    for q, own in found.groupby("query_id"):
        score = vectors @ vectors[q]
        best = [i for i in np.lexsort((np.arange(4000), -score)) if i != q][:20]
        hits += len(set(own["vec_id"]) & set(best))
    assert len(found) == 4000 and hits / 4000 >= 0.9


def test_shared_sums_are_footrule_distances():
    """For prefixes with places beyond counted as the length, the footrule distance is what two disjoint orders have less twice what is shared."""
    rng = np.random.default_rng(2)
    own = np.array([rng.permutation(12)[:5] for _ in range(40)])
    files = permindex.PivotFiles(own, 12)
    place = np.full((40, 12), 5)
    for i, o in enumerate(own):
        place[i, o] = np.arange(5)
    for i in range(40):
        assert (2 * files.shared(own[i]) == 2 * sum(range(1, 6)) - np.abs(place - place[i]).sum(1)).all()


def test_search_of_copies_and_ties(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(3000, 24))
    vectors[500:900] = vectors[500] * 3
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    settings = permindex.PermutationSettings(rows=500, queries=10)
    found = permindex.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, 20, settings).collect()
    got: dict[int, list] = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for q in range(0, 3000, 100):
        score = vectors @ vectors[q]
        assert np.allclose([s for _, s in got[q]], score[[i for i, _ in got[q]]]) and len(got[q]) == 20
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))
    assert [i for i, _ in got[500]][:20] == list(range(501, 521))


def test_search_awkward(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0]), (None, [1.0, 1.0]), (20, [-1.0, 0.0]), (7, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("vector", F.lit(1))
    found = permindex.search(df, F.col("vec_id") % 20 == 0)
    assert shown(found) == [(0, 1, 1, 0.5), (0, 2, 20, -1.0), (20, 1, 1, -0.5), (20, 2, 0, -1.0)]
    assert permindex.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_pipeline_stages_equal_plain_python(spark, awkward, tmp_path):
    import corpus_pipeline as pipeline

    docs, states = awkward, []
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        states.append(docs.collect())
        if i < 4:
            assert tuple(docs.columns) == pipeline.COLUMNS
    rows = awkward.collect()
    from maskwright.llm import repetition

    verdicts = repetition.measure([(r["text"] or "").encode() for r in rows], repetition.RepetitionRules())
    good = [r for r, v in zip(rows, verdicts, strict=True) if v["kept"]]
    assert sorted(((r["doc_id"], r["text"]) for r in states[0]), key=repr) == sorted(((r["doc_id"], r["text"]) for r in good), key=repr)
    prints = [simhash.fingerprint(r["text"].encode()) for r in good]
    own = roots(len(good), [(a, b) for a, b in combinations(range(len(good)), 2) if (prints[a] ^ prints[b]).bit_count() <= 4])
    assert len(states[1]) == len(set(own))
    clean = sorted((pii_lstm.redacted(r["text"], every) for r, (_, every) in zip(states[1], pii_lstm.find([r["text"] for r in states[1]], pii_lstm.default_tagger()), strict=True)))
    assert sorted(r["text"] for r in states[2]) == clean and all(r["n_chars"] == len(r["text"]) for r in states[2])
    words = sum(len(r["text"].split()) for r in states[2])
    assert abs(sum(len(r["text"].split()) for r in states[3]) - words) < 0.05 * words + 200
    assert sum(r["n_words"] for r in states[4]) == sum(len(r["text"].split()) for r in states[3])


def test_pipeline_of_nothing(spark, nothing):
    import corpus_pipeline as pipeline

    docs = nothing
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
