"""Operators on documents against brute force, on odd rows and on the smallest tables."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gatewright.llm import fingerprints, language_id, lm_scoring, near_dedup, packing, passages, pieces, sharding, shingles
from tests.compare import duck_rows, spark_rows
from tests.llm.conftest import TEXTS

SF_DIR = "/root/testdata/sf0.001"
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def components(n, links):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingle_sets(texts, n):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    return out


def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


def test_scores_of_odd_rows(odd, empty):
    rows = odd.withColumn("held", F.col("doc_id") % 3 == 0)
    got = lm_scoring.score_documents(rows, "doc_id", "text", "held").collect()
    assert len(got) == len(TEXTS)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        assert math.isfinite(r["score"]) and r["score"] < 0 and r["base_score"] < 0
    assert {r["n_tokens"] for k in (1, 2, 3) for r in by[k]} == {1}
    assert len(by[5]) == 2 and by[5][0] == by[5][1]
    assert lm_scoring.score_documents(empty.withColumn("held", F.lit(False)), "doc_id", "text", "held").count() == 0
    uniform = lm_scoring.score_documents(odd.withColumn("held", F.lit(True)), "doc_id", "text", "held").where("doc_id = 4").first()
    assert uniform["score"] == pytest.approx(-5 * math.log10(256)) and uniform["n_known"] == 0


def test_scores_equal_brute_force(spark):
    """Counts, escape estimates, exclusion and the base score, from the definition, for 25 documents."""
    docs = documents(spark)
    train = {k for k in docs if zlib.crc32(str(k).encode()) % 7 != 2}
    spell = lambda t: b" " + b"".join(w + b" " for w in t.encode().lower().split()) + b"\n"
    counts = defaultdict(Counter)
    for k in train:
        s = spell(docs[k])
        for i in range(1, len(s)):
            for j in range(min(i, lm_scoring.ORDER) + 1):
                counts[s[i - j : i]][s[i]] += 1
    size = lambda n: n if n < 6 else min(6 + math.floor(2 * math.log2(n / 6)), lm_scoring.N_BINS - 1)
    events = defaultdict(lambda: [0, 0])
    for c, own in counts.items():
        n = sum(own.values())
        for times in own.values() if n > 1 else ():
            new = times == 1
            events[len(c), size(n - 1), min(len(own) - new, lm_scoring.Q_BINS - 1)][0 if new else 1] += times

    def logp(context, byte):
        out, seen = 0.0, set()
        for j in range(len(context), -1, -1):
            every = counts.get(context[len(context) - j :], {})
            own = {b: c for b, c in every.items() if b not in seen}
            if own:
                n, left = sum(every.values()), sum(own.values())
                cell = events.get((j, size(n), min(len(every), lm_scoring.Q_BINS - 1)))
                e = (cell[0] + 0.5) / (sum(cell) + 1.5) if cell else len(every) / (n + len(every))
                e = e / (e + (1 - e) * left / n)
                if byte in own:
                    return out + math.log10((1 - e) * own[byte] / left)
                out += math.log10(e)
                seen |= set(own)
        return out - math.log10(256 - len(seen))

    words = Counter(w for k in train for w in docs[k].encode().lower().split())
    n, v = sum(words.values()) + len(train), len(words) + 1
    got = {r["doc_id"]: r for r in lm_scoring.op1_lm_scoring(spark, SF_DIR).collect()}
    assert set(got) == set(docs)
    for k in sorted(docs, key=lambda k: len(docs[k]))[:25]:
        s, tokens = spell(docs[k]), docs[k].encode().lower().split()
        want = sum(logp(s[max(0, i - lm_scoring.ORDER) : i], s[i]) for i in range(1, len(s)))
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tokens) + math.log10((len(train) + 1) / (n + v + 1))
        r = got[k]
        assert r["score"] == pytest.approx(want, rel=1e-9) and r["base_score"] == pytest.approx(base, rel=1e-9)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (k not in train, len(tokens) + 1, sum(words[w] > 0 for w in tokens) + 1, n)


def test_scores_are_a_distribution():
    """After any context the probabilities of all bytes sum to one."""
    rng = np.random.default_rng(1)
    words = [bytes(rng.choice(list(b"abcd"), rng.integers(1, 6))) for _ in range(300)]
    codes, counts = lm_scoring.with_suffixes(*lm_scoring.distinct(lm_scoring.text_codes([words])[0]))
    escapes = lm_scoring.Escapes(lm_scoring.escape_events(codes, counts))
    low = lm_scoring.low_nodes([(c, n) for c, n in zip(codes.tolist(), counts.tolist()) if (c >> 8) & 7 <= 1], escapes)
    asked = sorted({(c >> 8 << 8) | b for c in codes[::37].tolist() for b in range(256)} | set(codes.tolist()))
    seen = dict(zip(codes.tolist(), counts.tolist()))
    values = dict(lm_scoring.sweep(((c, seen.get(c, 0), True) for c in asked), low, escapes))
    for place in {c >> 8 for c in codes[::37].tolist()}:
        assert sum(10 ** values[place << 8 | b] for b in range(256)) == pytest.approx(1)


def test_known_words_beat_the_base(spark):
    """On held-out documents all of whose words are known, the model beats the unigram base."""
    rows = [r for r in lm_scoring.op1_lm_scoring(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    known = [r for r in rows if r["n_known"] >= 0.97 * r["n_tokens"]]
    assert len(known) > 5 and sum(r["score"] for r in known) > sum(r["base_score"] for r in known)


def test_scores_across_ranges(spark, monkeypatch):
    """Small ranges and groups give the same scores."""
    want = {r["doc_id"]: r["score"] for r in lm_scoring.op1_lm_scoring(spark, SF_DIR).collect()}
    for name, value in (("RANGE_CODES", 20_000), ("GROUP_BYTES", 100_000), ("CODED_BYTES", 5_000), ("ASKING_GROUPS", 2)):
        monkeypatch.setattr(lm_scoring, name, value)
    got = {r["doc_id"]: r["score"] for r in lm_scoring.op1_lm_scoring(spark, SF_DIR).collect()}
    assert got == {k: pytest.approx(v, rel=1e-12) for k, v in want.items()}


def test_adaptive_scores_learn():
    assert lm_scoring.adaptive_score("abc abc abc abc") > 2 * lm_scoring.adaptive_score("abc abc")
    assert lm_scoring.adaptive_score(None) == pytest.approx(-math.log10(256))


def test_token_ids_are_the_librarys(odd):
    from tokenizers import Tokenizer

    own, library = packing.BytePairIds(BPE), Tokenizer.from_file(BPE)
    texts = [t or "" for _, t in TEXTS] + ["a  b", " a", "a ", "a\n b", "a \n\tb", "x.\n\n\ny", "it's, they'll", "a  b", "<|endoftext|> a", "..a.. b,c", "²½ x²"]
    rng = np.random.default_rng(8)
    kinds = ["a", "B", "7", "²", "é", "ß", "Ж", "ا", "क", "ก", "日", "か", "한", "\U0001d400", "\U0001f642", "\u0085", "\u00a0", "\u2003", "\u200b", "\u2028", "\u3000", "\ufeff", "\x00", "\x1c", "\t", "\n", "\r", " ", " ", "'", "'s", "'ll", ".", "-", "\u0301", "\ua7d0", "\U00011f04", "\u1c89"]
    texts += ["".join(rng.choice(kinds, rng.integers(1, 30))) for _ in range(3000)] + ["ab" * 5000, "=" * 3000, " " * 2000 + "x"]
    assert own.fast is not None
    for t in texts:
        assert np.frombuffer(own.ids(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_packing_of_odd_rows(odd, empty):
    rows = packing.pack_documents(odd, "doc_id", "text", BPE).collect()
    check_packing(rows)
    lengths = [r["length"] for r in rows]
    assert max(lengths) == 1024 and len({r["sequence_id"] for r in rows}) <= -(-sum(lengths) // 1024) + 1
    per = defaultdict(list)
    for r in rows:
        per[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    assert per[1] == per[2] == [(0, 0, 1)] and len(per[5]) == 2
    long = sorted(per[15])
    assert all(n == 1024 for _, _, n in long[1:]) and [a for _, a, _ in long] == [sum(n for _, _, n in long[:i]) for i in range(len(long))]
    assert packing.pack_documents(empty, "doc_id", "text", BPE).count() == 0


def check_packing(rows):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024


def test_crossover_keeps_every_item():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 1024, 500).tolist()
    a, b = (packing.first_packing(lengths, 1024, rng, s) for s in (0.0, 0.8))
    child = packing.crossover(a, b, rng)
    assert sorted(i for items in child.bins for i in items) == list(range(500))
    assert all(sum(lengths[i] for i in items) == f <= 1024 for items, f in zip(child.bins, child.fill, strict=True))
    assert len(packing.evolve(lengths, 1024, 1, []).bins) <= len(a.bins)


def test_near_duplicates_equal_brute_force(spark):
    docs = documents(spark)
    ids = sorted(docs)
    sets = shingle_sets([docs[i] for i in ids], 3)
    links = [(i, j) for i in range(len(ids)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = {ids[i]: ids[c] for i, c in enumerate(components(len(ids), links))}
    got = near_dedup.op3_near_dedup(spark, SF_DIR).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {k: len(s) for k, s in zip(ids, sets, strict=True)}


def test_near_duplicates_of_odd_rows(odd, empty):
    got = near_dedup.near_duplicates(odd, "doc_id", "text", 3, 85, 100).collect()
    assert len(got) == len(TEXTS)
    component = {r["doc_id"]: r["component_id"] for r in got}
    assert component[4] == component[5] == 4 and component[6] == component[7] == 6 and component[8] == component[9] == 8
    assert component[1] == 1 and component[2] == 2 and component[3] == 3 and component[10] == 10
    kept = near_dedup.deduplicate(odd, "doc_id", "text", 3, 85, 100)
    assert kept.columns == odd.columns and kept.where("doc_id is null").count() == 1
    assert near_dedup.near_duplicates(empty, "doc_id", "text").count() == 0


def test_bayes_never_prunes_at_the_threshold():
    plan = shingles.tune(3, 85, 100, 1e-6, 96)
    for n, least in shingles.posterior_table(plan, 16, 1e-7):
        assert least <= math.ceil(plan.similarity * n)
        assert least > 0.3 * n


def test_tuned_bands_keep_the_recall():
    for over in (70, 80, 85, 95):
        plan = shingles.tune(5, over, 100, 1e-5)
        assert (1 - (over / 100) ** plan.rows) ** plan.bands <= 1e-5


def test_language_id_on_held_out_documents(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = [r for r in language_id.op4_language_id(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in got) >= 0.98 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_id_of_odd_rows(odd, empty):
    model = language_id.train(odd, "doc_id", "text", "lang", F.lit(True))
    got = {r["doc_id"]: r for r in language_id.predict(odd, "doc_id", "text", model).collect()}
    assert {got[k]["lang_pred"] for k in (1, 2, 3, 11)} == {"und"} and got[1]["score"] == 0
    assert got[8]["lang_pred"] == "en" and got[8]["cls"] is not None
    assert language_id.predict(empty, "doc_id", "text", model).count() == 0
    untrained = language_id.train(empty, "doc_id", "text", "lang", F.lit(True))
    assert language_id.predict(odd, "doc_id", "text", untrained).where("lang_pred <> 'und'").count() == 0


def test_paragraphs_equal_brute_force(spark):
    docs = documents(spark)
    place, sets = [], []
    for k in sorted(docs):
        at = 0
        for line in docs[k].split("\n"):
            w = line.encode().lower().split()
            if len(w) >= passages.LEAST_WORDS:
                place.append((k, at, at + len(line)))
                sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
            at += len(line) + 1
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    links = {(i, j) for h in holders.values() for i in h for j in h if j < i}
    links = [(i, j) for i, j in links if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    groups = defaultdict(set)
    for i, c in enumerate(components(len(sets), links)):
        groups[c].add(place[i])
    got = defaultdict(set)
    for r in passages.repeated_paragraphs(spark.read.parquet(f"{SF_DIR}/documents.parquet"), "doc_id", "text").collect():
        got[r["component_id"]].add((r["doc_id"], r["start"], r["end"]))
    assert {frozenset(g) for g in got.values()} == {frozenset(g) for g in groups.values() if len(g) > 1}


def test_passages_of_odd_rows(odd, empty):
    got = {(r["doc_id"], r["source"]): r for r in passages.clean(odd, "doc_id", "text").collect()}
    assert len(got) == len(TEXTS)
    text = {k: (r["text"], r["removed"]) for (k, _), r in got.items()}
    assert text[1] == (None, []) and text[2] == ("", []) and text[13][1] == []
    assert text[14][0] == "another first line\nanother end"
    assert "p30" in text[16][0] and "p30" not in text[17][0] and text[17][0].startswith("quite another beginning")
    assert passages.clean(empty, "doc_id", "text").count() == 0


def test_short_lines_are_paragraphs(spark):
    """Lines of five words or more, and a wrapped paragraph of which one line is edited."""
    wrapped = [" ".join(f"l{i}x{j}" for j in range(9)) for i in range(6)]
    edited = [*wrapped[:3], "quite other words are in this line now", *wrapped[4:]]
    line = " ".join(f"n{j}" for j in range(19))
    rows = [(1, "\n".join(wrapped)), (2, "\n".join(edited)), *[(k, f"own{k} start\n{line}\nown{k} middle\nfive words are a line\nfour words are not\nown{k} end") for k in range(3, 9)]]
    got = {r["doc_id"]: r["text"] for r in passages.clean(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got[1] == rows[0][1] and got[2].strip() == edited[3] and got[3] == rows[2][1]
    assert all(got[k] == f"own{k} start\nown{k} middle\nfour words are not\nown{k} end" for k in range(4, 9))


def test_passages_go_whole(spark):
    """A run of 47 words or more within other lines goes with its first and last word, and nothing else does."""
    rows, runs = [], []
    for i, n in enumerate([47, 51, 55, 60, 64, 80, 120, 200] * 3):
        run = [f"r{i}x{j}" for j in range(n)]
        for copy in range(3):
            rows.append((3 * i + copy, " ".join([*[f"a{i}c{copy}x{j}" for j in range(7 * copy + 30)], *run, *[f"b{i}c{copy}x{j}" for j in range(31)]])))
        runs.append(run)
    got = {r["doc_id"]: r["text"].split() for r in passages.clean(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    for k, text in rows:
        lost = runs[k // 3] if k % 3 else []
        assert got[k] == [w for w in text.split() if w not in set(lost)]


def test_passages_go_from_every_place(spark):
    """All places but the first of a passage go, within the owning document and in others."""
    run = [f"r{j}" for j in range(60)]
    own = [[f"o{i}x{j}" for j in range(30)] for i in range(12)]
    many = " ".join(" ".join([*run, *x]) for x in own)
    rows = [(1, many), (2, " ".join([*own[0][:9], many])), (3, " ".join(f"s{j}" for j in range(9)) + " " + " ".join(["again", "and"] * 200)), (4, "alone " + " ".join(["same"] * 100))]
    got = {r["doc_id"]: r["text"].split() for r in passages.clean(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got[1] == run + [w for x in own for w in x]
    assert not set(got[2]) & set(run)
    assert got[3] == [f"s{j}" for j in range(9)] + (["again", "and"] * 13)[: len(got[3]) - 9] and 24 <= len(got[3]) - 9 <= 26
    assert got[4] == ["alone", *["same"] * 24]


def test_windows_guarantee():
    """Any run of 2 * size - 1 words that two texts share has a kept window in common."""
    rng = np.random.default_rng(3)
    for _ in range(50):
        run = rng.integers(0, 1 << 62, 2 * passages.WINDOW - 1).astype(np.uint64)
        a, b = (np.concatenate([rng.integers(0, 1 << 62, rng.integers(0, 80)).astype(np.uint64), run, rng.integers(0, 1 << 62, rng.integers(0, 80)).astype(np.uint64)]) for _ in range(2))
        assert set(passages.window_places(a)[1].tolist()) & set(passages.window_places(b)[1].tolist())


def test_fingerprints_of_odd_rows(odd, empty):
    got = {(r["doc_id"], r["source"]): r["entries"] for r in fingerprints.winnow(odd).collect()}
    by = {k: e for (k, _), e in got.items()}
    assert by[1] == by[2] == by[3] == [] and by[4] == by[5] and len(by[4]) == 1
    assert by[6] == by[7] != by[8] and by[8] != by[10] and set(by[8]) & set(by[9])
    assert fingerprints.winnow(empty).count() == 0 and fingerprints.with_next(empty, "doc_id", ["text"]).count() == 0
    following = {(r["doc_id"], r["source"]): r["next_text"] for r in fingerprints.with_next(odd.where("doc_id is null or doc_id <> 5"), "doc_id", ["text"], 4).collect()}
    text = {k: t for k, t in TEXTS if k != 5}
    order = [*sorted((k for k in text if k is not None), reverse=True), None]
    assert {k: t for (k, _), t in following.items()} == {k: text[n] for k, n in zip(order, [*order[1:], order[0]], strict=True)}


def test_winnowing_picks_rightmost_minima(spark):
    rows = spark.createDataFrame([(" ".join(["same"] * 30),)], "text string")
    positions = [e & ((1 << fingerprints.POSITION_BITS) - 1) for e in fingerprints.winnow(rows).first()["entries"]]
    assert positions == list(range(7, 27))  # of equal hashes the last of each window of 8


def test_shards_match_sql(spark):
    assert spark_rows(sharding.op7_sharding(spark, SF_DIR)) == duck_rows(sharding.ORACLE_SQL["op7_sharding"], SF_DIR)


def test_shards_of_odd_rows(odd, empty):
    got = sharding.assign(odd, "doc_id", sharding.topology(8), slot="slot", ties=("source",)).collect()
    assert len(got) == len(TEXTS)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert sharding.assign(empty, "doc_id", sharding.topology(8), slot="slot").count() == 0


@pytest.mark.parametrize("shards", [1, 8, 9, 10])
def test_any_shape_grows_into_the_new_shard_alone(spark, shards):
    shape = sharding.topology(shards)
    rows = spark.range(3000).select(sharding.shard_of(F.col("id"), shape).alias("a"), sharding.shard_of(F.col("id"), sharding.grown(shape)).alias("b")).collect()
    assert all(r["a"] == r["b"] or r["b"] == shards for r in rows) and any(r["b"] == shards for r in rows)


def test_clashing_columns_are_replaced(spark):
    rows = spark.createDataFrame([(1, "a b c d e f", [1], "x", 7, 8, 9), (2, "g h", [2], "y", 7, 8, 9)], "doc_id long, text string, entries array<int>, next_text string, shard int, slot int, __part int")
    assert len(fingerprints.winnow(rows).where("doc_id = 1").first()["entries"]) == 1
    assert {r["doc_id"]: r["next_text"] for r in fingerprints.with_next(rows, "doc_id", ["text"]).collect()} == {2: "a b c d e f", 1: "g h"}
    got = sharding.assign(rows, "doc_id", sharding.topology(8), slot="slot").collect()
    assert all(0 <= r["shard"] < 8 and r["slot"] in (0, 1) for r in got)


def test_fingerprint_query_equals_brute_force(spark):
    """Every column of op6 from the definition: edited texts, fingerprints by winnowing, Jaccard coefficients."""
    import re

    import xxhash

    docs = documents(spark)
    rows = {r["doc_id"]: r for r in fingerprints.op6_winnowing(spark, SF_DIR).collect()}
    order = sorted(docs, reverse=True)
    edited = {}
    for k, n in zip(order, [*order[1:], order[0]], strict=True):
        half = len(docs[k]) // 2
        edited[k] = docs[k][: len(docs[k]) - half] + docs[n][:half]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    word = lambda b: signed(xxhash.xxh64_intdigest(b, 42))

    def pair(a, b):
        first = xxhash.xxh64_intdigest((a & (2**64 - 1)).to_bytes(8, "little"), 42)
        return signed(xxhash.xxh64_intdigest((b & (2**64 - 1)).to_bytes(8, "little"), first))

    low = (1 << fingerprints.POSITION_BITS) - 1

    def entries(text):
        hashes = [word(w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]{1,24}", text.lower())]
        two = [pair(a, b) for a, b in zip(hashes, hashes[1:], strict=False)]
        grams = [pair(a, b) for a, b in zip(two, two[2:], strict=False)]
        if not grams and hashes:
            s = 0
            for h in hashes:
                s = pair(s, h)
            grams = [s]
        packed = [(g & ~low) | (i & low) for i, g in enumerate(grams)]
        out = []
        for i in range(max(len(packed) - 7, 1 if packed else 0)):
            best = min(packed[i : i + 8], key=lambda e: (e >> fingerprints.POSITION_BITS, -(e & low)))
            if best not in out:
                out.append(best)
        return out

    def jaccard(a, b):
        a, b = ({e >> fingerprints.POSITION_BITS for e in x} for x in (a, b))
        return len(a & b) / len(a | b) if a | b else 1.0

    own = {k: entries(t) for k, t in docs.items()}
    for k, n in zip(order, [*order[1:], order[0]], strict=True):
        r, e = rows[k], entries(edited[k])
        spelt = lambda x: ",".join(f"{v & (2**64 - 1):X}" for v in x)
        assert r["n_chars"] == len(docs[k]) and r["edited_sha256"] == hashlib.sha256(edited[k].encode()).hexdigest()
        assert r["fingerprint"] == spelt(own[k]) and r["edited_fingerprint"] == spelt(e)
        assert r["near_edited"] == pytest.approx(jaccard(own[k], e)) and r["near_next"] == pytest.approx(jaccard(own[k], own[n]))


def test_packing_query_equals_the_library(spark):
    """Ids, starts and gapless places of all documents of the smallest table."""
    from tokenizers import Tokenizer

    library, docs = Tokenizer.from_file(BPE), documents(spark)
    rows = packing.op2_packing(spark, SF_DIR).collect()
    per, fill = defaultdict(list), defaultdict(list)
    for r in rows:
        per[r["doc_id"]].append(r)
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for k, t in docs.items():
        ids, at = [*library.encode(t, add_special_tokens=False).ids, 2], 0
        for i, r in enumerate(sorted(per[k], key=lambda r: r["piece"])):
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert (r["piece"], r["start"], r["ids_crc32"]) == (i, at, zlib.crc32(part.tobytes()))
            at += r["length"]
        assert at == len(ids) and (len(per[k]) == 1) == (len(ids) <= 1024)
        total += len(ids)
    for places in fill.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(fill) <= -(-total // 1024) + 2


def test_passage_rows_equal_brute_force(spark):
    """On all rows of the smallest table: every run of 47 words that stands at an earlier place too, outside lines that go,
    is covered by the spans, and every word of a span lies in a window of 24 words that another place has."""
    import re

    docs = documents(spark)
    rows = passages.op5_passages(spark, SF_DIR).collect()
    gone, spans = defaultdict(list), defaultdict(list)
    for r in rows:
        if r["kind"] == "paragraph" and not r["kept"]:
            gone[r["doc_id"]].append((r["start"], r["end"]))
        elif r["kind"] == "passage":
            assert r["component_id"] == -1 and not r["kept"]
            spans[r["doc_id"]].append((r["start"], r["end"]))
    words = {}
    for k, t in docs.items():
        out = []
        for w in re.finditer(r"[^\x20\x09-\x0D]+", t):
            lost = any(a <= w.start() and w.end() <= b for a, b in gone[k])
            out.append((None if lost else w.group().encode().lower(), w.start(), w.end()))
        words[k] = out

    def grams(size):
        for k in sorted(words):
            w = words[k]
            for i in range(len(w) - size + 1):
                part = [x[0] for x in w[i : i + size]]
                if None not in part:
                    yield b" ".join(part), k, i

    seen = set()
    for g, k, i in grams(2 * passages.WINDOW - 1):
        if g in seen:
            a, b = words[k][i][1], words[k][i + 2 * passages.WINDOW - 2][2]
            assert any(x <= a and b <= y for x, y in spans[k]) or any(words[k][j][0] == words[k][i][0] for j in range(max(0, i - 60), i)), (k, i)
        seen.add(g)
    times = Counter(g for g, *_ in grams(passages.WINDOW))
    covered = defaultdict(set)
    for g, k, i in grams(passages.WINDOW):
        if times[g] > 1:
            covered[k].update(range(i, i + passages.WINDOW))
    for k, found in spans.items():
        for n, w in enumerate(words[k]):
            if any(a <= w[1] and w[2] <= b for a, b in found):
                assert n in covered[k]


def test_a_new_shard_takes_rows_only_into_itself(spark):
    rows = spark.range(4000).select(sharding.shard_of(F.col("id"), sharding.topology(8)).alias("a"), sharding.shard_of(F.col("id"), sharding.topology(9)).alias("b")).collect()
    assert all(r["a"] == r["b"] or r["b"] == 8 for r in rows)
    assert max(Counter(r["a"] for r in rows).values()) < 1.25 * 4000 / 8 and abs(sum(r["b"] == 8 for r in rows) - 4000 / 9) < 100


def test_a_weight_moves_rows_only_with_its_subtree(spark):
    before = sharding.topology(8)
    after = [(g, k, s, 3.0 if s == 5 else w) for g, k, s, w in before]
    rows = spark.range(4000).select(sharding.shard_of(F.col("id"), before).alias("a"), sharding.shard_of(F.col("id"), after).alias("b")).collect()
    assert all(r["b"] // 4 == 1 for r in rows if r["a"] != r["b"])  # into its region


def test_pieces_are_the_librarys(odd):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for rows in (pieces.encode_columns(odd, "doc_id", "text", PIECES).collect(),):
        assert len(rows) == len(TEXTS)
        text = {k: t or "" for k, t in TEXTS}
        for r in rows:
            ids = library.encode(text[r["doc_id"]])
            assert r["ids"] == ids and r["decoded"] == library.decode(ids)


def test_piece_digests(odd, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    text = {k: t or "" for k, t in TEXTS}
    for r in pieces.encode_columns(odd, "doc_id", "text", PIECES, digests=True).collect():
        ids = library.encode(text[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.encode_columns(empty, "doc_id", "text", PIECES).count() == 0


def test_decoding_any_ids():
    import sentencepiece

    library, own, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.encoder(PIECES), np.random.default_rng(5)
    for _ in range(500):
        ids = np.where(rng.random(8) < 0.5, rng.integers(3, 259, 8), rng.integers(0, 32000, 8)).tolist()
        assert own.decode(ids) == library.decode(ids)
