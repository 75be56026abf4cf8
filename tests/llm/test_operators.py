"""Each operator against brute force on small tables, with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import hmac
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tabloom.llm import bsi_topk, common, edit_counts, exact_dedup, minhash, mixing, packing, pseudonyms, queries, substring_dedup, tokens, toxicity, weak_quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size string"
WORD = r"[^\x20\x09-\x0D]+"


def rows():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 6))) for _ in range(400)]
    passage = " ".join(rng.choices(words, k=70))
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 120))) for _ in range(30)]
    texts += [texts[3], texts[3].replace(" ", "\n ", 1), texts[4] + " " + passage, passage + " end", "start " + passage]
    near = rng.choices(words, k=200)
    for k in range(4):
        texts.append(" ".join(near[:150] + [f"x{k}"] + near[150:]))
    texts += ["", None, "   ", "one", "Two WORDS", "x " * 5000]
    out = [(k, t, "en", ["a", "b", None][k % 3], 0, True, "clash") for k, t in enumerate(texts)]
    return out + [(3, texts[3], "en", "a", 0, False, "clash"), (None, texts[3], "en", "a", 0, False, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def as_id(i):
    return (1 << 63) - 1 if i is None else i


def test_exact_dedup(docs, empty):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for r in rows():
        groups[norm(r[1])].append(as_id(r[0]))
    got = exact_dedup.exact_dedup(docs).collect()
    want = Counter((r[0], min(groups[norm(r[1])]), len(groups[norm(r[1])]), hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in rows())
    assert Counter((r.doc_id, as_id(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_trie_spills_finished_subtrees(monkeypatch, docs):
    monkeypatch.setattr(exact_dedup, "TRIE_BYTES", 10)
    trie = exact_dedup.PatriciaTrie()
    for k, key in enumerate([b"ab", b"abc", b"abd", b"ac", b"ab", b""]):
        trie.insert(key, 9 - k)
    assert dict((k, (i, n)) for k, i, n in trie.items()) == {b"": (4, 1), b"ab": (5, 2), b"abc": (8, 1), b"abd": (7, 1), b"ac": (6, 1)}
    gone = [k for k, _, _ in trie.spill(b"abd")]
    assert sorted(gone + [k for k, _, _ in trie.items()]) == [b"", b"ab", b"abc", b"abd", b"ac"] and b"abd" not in gone


def test_owners_spill(monkeypatch):
    monkeypatch.setattr(exact_dedup, "TRIE_BYTES", 10)
    bodies = sorted({f"text {k % 7}" + "x" * (k % 3) for k in range(40)}, key=lambda b: (len(b), xxhash.xxh64_intdigest(b.encode())))
    data = [(len(b), xxhash.xxh64_intdigest(b.encode()) - (1 << 63), b.encode(), k, 1) for b in bodies for k in (5, 3)]
    batches = [exact_dedup._batch(data[k : k + 3], exact_dedup._LOCAL) for k in range(0, len(data), 3)]
    got = {r["text_sha256"]: (r["keep_id"], r["group_size"]) for b in exact_dedup._owners(iter(batches)) for r in b.to_pylist()}
    assert got == {hashlib.sha256(b.encode()).hexdigest(): (3, 2) for b in bodies}


def test_substring_dedup_in_small_flushes_and_two_levels(spark, docs):
    want = Counter(map(tuple, substring_dedup.substring_dedup(docs).collect()))
    got = substring_dedup.substring_dedup(docs, flush=60, bucket_windows=4, level_bits=3)
    assert Counter(map(tuple, got.collect())) == want
    passage = " ".join(f"w{k}" for k in range(60))
    nulls = spark.createDataFrame([(None, f"{k} {passage}") for k in range(5)] + [(9, passage), (4, passage + " end")], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(nulls, flush=30).collect())
    assert got == Counter({(None, 61, 60): 5, (9, 60, 60): 1, (4, 61, 0): 1})


def test_substring_dedup(docs, empty):
    data = [(as_id(r[0]), re.findall(WORD, r[1] or "")) for r in rows()]
    first = {}
    for i, w in data:
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            first[key] = min(i, first.get(key, i))
    want = Counter()
    for i, w in data:
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[(i, len(w), len(gone), kept)] += 1
    got = substring_dedup.substring_dedup(docs).collect()
    assert Counter((as_id(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in got) == want
    assert any(r.n_removed for r in got)
    assert substring_dedup.substring_dedup(empty).count() == 0


def shingles(text):
    w = re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_dedup(docs, empty):
    data = [(as_id(r[0]), shingles(r[1])) for r in rows()]
    owner = list(range(len(data)))

    def root(k):
        while owner[k] != k:
            k = owner[k]
        return k

    for a in range(len(data)):
        for b in range(a):
            x, y = data[a][1], data[b][1]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                owner[root(a)] = root(b)
    least = defaultdict(lambda: 1 << 63)
    for k, (i, _) in enumerate(data):
        least[root(k)] = min(least[root(k)], i)
    want = Counter((i, len(s), least[root(k)]) for k, (i, s) in enumerate(data))
    got = minhash.near_dedup(docs).collect()
    assert Counter((as_id(r.doc_id), r.n_shingles, as_id(r.component_id)) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert minhash.near_dedup(empty).count() == 0


def test_near_dedup_links_that_miss_the_hub(spark):
    """A chain: neighbours are similar enough, the ends are not; every one belongs to one component."""
    rng = random.Random(1)
    w = [str(rng.random()) for _ in range(400)]
    texts = [" ".join(w[4 * k : 4 * k + 200]) for k in range(10)]
    got = minhash.near_dedup(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}


def test_near_dedup_in_buckets_of_many_unlinked_texts(spark):
    """Boilerplate pages that share three quarters of their words, and pairs of near copies among them."""
    rng = random.Random(12)
    base = [str(rng.random()) for _ in range(300)]
    texts = []
    for _ in range(60):
        own = [str(rng.random()) for _ in range(100)]
        texts.append(base + own)
        if rng.random() < 0.4:
            texts.append(base + own[:80] + [str(rng.random()) for _ in range(rng.randint(1, 40))])
    rng.shuffle(texts)
    data = [(k, " ".join(t)) for k, t in enumerate(texts)]
    sets = [shingles(t) for _, t in data]
    for percent in (85, 80):
        least = list(range(len(data)))
        for _ in range(3):
            for a in range(len(data)):
                for b in range(a):
                    if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                        least[a] = least[b] = min(least[a], least[b])
        got = {r.doc_id: r.component_id for r in minhash.near_dedup(spark.createDataFrame(data, "doc_id long, text string"), percent=percent).collect()}
        assert got == dict(enumerate(least)) and len(set(least)) < len(least)


def test_mixing(docs, empty):
    got = mixing.mixture(docs).collect()
    total = sum(r.size for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.source_key].append(r)
        assert r.taken <= 3 * r.size and 0 <= r.position <= 1
    assert abs(sum(x[0].target for x in by.values()) - total) < 1e-6 * total
    for own in by.values():
        assert own[0].target <= 3 * own[0].source_size + 1e-9
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) / 2 + 1
        for a, b in zip(sorted(own, key=lambda r: r.position), sorted(own, key=lambda r: r.before)):
            assert a.position == b.position  # within a source, positions follow the order of places
    for r in got:  # the inverse of t + slope * (t * t - t), the source's share of its demand by time t
        demand = min(1.0, (r.before + r.size / 2) / r.target) if r.target else 0.0
        assert abs(r.position + r.slope * (r.position**2 - r.position) - demand) < 1e-9
    sorted_ = [r.position for r in mixing.curriculum(docs).collect()]
    assert sorted_ == sorted(sorted_)
    odd = docs.select("doc_id", "text", "source").selectExpr("*", "map('a', 1) AS m", "1 AS size", "2 AS bucket")
    assert mixing.mix(odd).count() == sum(r.copies for r in got)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in got)
    assert mixing.mixture(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_packing(docs, empty):
    pieces = tokens.Pieces()
    want = Counter((r[0], len(pieces.full.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in rows())
    got = packing.pack(docs).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    for own in sequences.values():
        assert sum(n for _, n in own) <= 2048
    ids = {}
    for r in rows():
        ids.setdefault(as_id(r[0]), []).append(pieces.full.encode(r[1] or "", add_special_tokens=False).ids + [1])
    for r in got:
        assert any(r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) for x in ids[as_id(r.doc_id)])
    covered = sum(r.length for r in got)
    assert covered == sum(len(x) for own in ids.values() for x in own) and sum(r.start == 0 for r in got) == len(rows())
    assert packing.pack(empty).count() == 0


def test_packing_is_first_fit_decreasing(spark):
    rng = random.Random(6)
    for n in (1, 2, 3, 50, 333):
        sizes, bins, want = [rng.randint(1, 2048) for _ in range(n)], [], {}
        for k in sorted(range(n), key=lambda k: (-sizes[k], k)):
            at = next((b for b, used in enumerate(bins) if used + sizes[k] <= 2048), len(bins))
            bins += [0] * (at == len(bins))
            want[k] = (at, bins[at])
            bins[at] += sizes[k]
        assert packing.first_fit_decreasing(sizes, 2048) == [want[k] for k in range(n)]
    same = spark.range(300).selectExpr("cast(null as long) AS doc_id", "'equal rows' AS text", "1 AS n", "2 AS copy")
    got = packing.pack(same, group_docs=20).collect()
    assert len(got) == 300 and len({r.sequence_id >> 32 for r in got}) > 8 and packing.pack(same, group_docs=20, length=2).count() > 300


def test_encoding_round_trip():
    pieces = tokens.Pieces()
    for text in ["a b  c", " lead", "tail ", "it's\n\nfine 3.5", "ünï 漢字", "x<|endoftext|>y", "", "\t"]:
        assert np.frombuffer(pieces.encode(text), "<u4").tolist() == pieces.full.encode(text, add_special_tokens=False).ids


def test_edit_counts(spark, docs, empty):
    pieces, rng = tokens.Pieces(), random.Random(2)
    count = lambda t: len(pieces.full.encode(t, add_special_tokens=False).ids)
    for r in rows():
        text = (r[1] or "")[:800]
        tree = edit_counts.TokenTree(text, pieces)
        for _ in range(5):
            at, gone, new = rng.randint(0, len(text) + 2), rng.choice([0, 1, 9, 300]), rng.choice(["", " ", "  ", "new words", "\n", ". "])
            tree.edit(at, gone, new)
            at = min(at, len(text))
            text = text[:at] + new + text[at + gone :]
            assert tree.text() == text and tree.total == count(text)
    edits = spark.createDataFrame([(0, 2, 0, 3, "zz"), (0, 1, 5, 0, " mid"), (999, 1, 0, 0, "x")], "doc_id long, seq int, at int, delete int, insert string")
    got = {r.doc_id: r for r in edit_counts.edit_counts(docs, edits).collect()}
    text = rows()[0][1]
    text = text[:5] + " mid" + text[5:]
    assert got[0].n_tokens_edited == count("zz" + text[3:]) and got[1].n_tokens == got[1].n_tokens_edited
    assert edit_counts.edit_counts(empty, edits).count() == 0


def test_bsi_topk(spark):
    rng = np.random.default_rng(1)
    vector = lambda n: [float(x) for x in rng.normal(0, 0.2, n)]
    data = [(int(i), vector(8)) for i in range(1, 300)]
    data += [(400, data[0][1]), (420, data[0][1]), (500, None), (520, [None] * 8), (540, [float("nan")] * 8), (560, [float("inf")] * 8), (580, []), (None, data[0][1])]
    data += [(1, data[0][1]), (7, vector(8)), (20, vector(8)), (20, data[19][1])]  # ids that repeat, with other and with equal vectors
    data += [(int(i), vector(3)) for i in range(600, 650)]  # another length
    data += [(int(i), [1e9 * x for x in vector(2)] + [1e300 if i % 2 else -1e300] * (i % 3 == 0)) for i in range(700, 730)]
    limit, end = 1 << 61, (1 << 63) - 1
    fine = [(i, [max(-limit, min(limit, int(np.floor(64 * c) if abs(c) < 1e200 else c))) for c in x]) for i, x in data if i is not None and x and None not in x and np.isfinite(x).all()]
    want = Counter()
    for q, (i, x) in enumerate(fine):
        if i % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), c) for k, (c, y) in enumerate(fine) if k != q and len(x) == len(y))[:20]
            want.update((i, n, c, max(-end - 1, min(end, -score))) for n, (score, c) in enumerate(scored, 1))
    df = spark.createDataFrame([(*r, "clash", 1) for r in data], "vec_id long, embedding array<double>, block string, salt int").repartition(3)
    for sizes in ({}, {"block_rows": 40, "block_queries": 3, "task_queries": 2}):
        assert Counter(map(tuple, bsi_topk.bsi_topk(df, **sizes).collect())) == want
    assert bsi_topk.bsi_topk(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_pseudonyms(spark, empty):
    text = "card 4111 1111 1111 1111 not 4111111111111112 on 1999-02-28 and 28/02/1999, no 1999-02-30; ip 1.2.3.4 no 999.1.1.1; +1 (310) 555-4510; ssn 078-05-1120; a.b7@x.org v2.0"
    df = spark.createDataFrame([(1, text), (2, text), (3, None), (4, ""), (None, "4111111111111111")], "doc_id long, text string")
    got = pseudonyms.pseudonymise(df, "k").collect()
    one, two = got[0].text, got[1].text
    assert one == two and got[2].text is None and got[3].text == "" and got[0].n_replaced == 7
    for gone in ("4111 1111 1111 1111", "1999-02-28", "28/02/1999", "1.2.3.4 ", "555-4510", "078-05-1120", "a.b7@"):
        assert gone not in one
    for stays in ("4111111111111112", "1999-02-30", "999.1.1.1", "v2.0", "@x.org"):
        assert stays in one
    card = re.search(r"card ([\d ]{19})", one)[1].replace(" ", "")
    assert card == got[4].text and sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(reversed(card))) % 10 == 0
    assert pseudonyms.pseudonymise(empty, "k").count() == 0


def test_pseudonyms_by_kind(spark):
    texts = [
        "4111 1111 1111 1111 12/26", "4111111111111111 123", "42 4111111111111111", "4111 1111 1111 1111 123", "born 03/25/1984, 02/29/2004.", "25/03/1984",
        "+44 20 7946 0958", "+33 1 23 45 67 89", "+1 310-555-4510; 310-555-4510; 310.555.4510; 310 555 4510; (310) 555-4510; +13105554510",
        "John.Smith@x.org john.smith@x.org", "abcdefghijklmnopqrstuvwxyzsecretsurname12345678901234567890123@x.org", "x" * 30_000 + " 1.2.3.4 " + "7" * 500, "13/13/1984 00/00/2000 30/02/2001",
    ]
    df = spark.createDataFrame([(k, t, "clash", 1) for k, t in enumerate(texts)], "doc_id long, text string, _matches string, kind int")
    out = pseudonyms.pseudonymise(df, "a secret key")
    got = [r.text for r in out.orderBy("doc_id").collect()]
    digits = lambda t: re.sub("[^0-9]", "", t)
    card = digits(got[0])[:16]
    assert card != "4" + "1" * 15 and got[0].endswith(" 12/26") and got[1] == f"{card} 123" and got[2] == f"42 {card}" and digits(got[3]) == card + "123"
    assert re.fullmatch(r"born \d\d/(1[3-9]|2\d|3[01])/\d{4}, 02/29/\d{4}\.", got[4]) and got[4] != texts[4] and got[5] != texts[5]
    assert got[6].startswith("+44 ") and got[6] != texts[6] and got[7].startswith("+33 ") and digits(got[7])[2:] != digits(texts[7])[2:]
    assert len({digits(x)[-10:] for x in got[8].split(";")}) == 1 and "555" not in got[8][:8] and got[8].startswith("+1 ")
    one, two = got[9].split()
    assert one.lower() == two and re.fullmatch(r"[A-Z][a-z]{3}\.[A-Z][a-z]{4}@x\.org", one) and "secret" not in got[10] and "mno" not in got[10] and digits(texts[10])[-5:] != digits(got[10])[-5:]
    assert " 1.2.3.4 " not in got[11] and got[11].endswith("7" * 500) and got[12] == texts[12]
    plan = out._jdf.queryExecution().toString()
    assert "secret" not in plan and b"a secret".hex() not in plan.lower() and "Python" not in plan


def test_pseudonyms_are_a_permutation(spark):
    days = spark.range(0, 3000).selectExpr("id AS doc_id", "date_format(date_add(date'1900-01-01', cast(id * 24 AS int)), 'yyyy-MM-dd') AS text")
    assert pseudonyms.pseudonymise(days, "k").select("text").distinct().count() == 3000


def labelled(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklm", k=rng.randint(3, 7))) for _ in range(300)]
    docs, labels = [], []
    for k in range(400):
        text = rng.choices(words, k=30)
        if k % 4 == 0:
            text[rng.randint(0, 29)] = rng.choice(["zorgul", "wubbex", "qyntop"])
        docs.append((k, " ".join(text)))
        labels.append((k, int(k % 4 == 0)))
    return spark.createDataFrame(docs + [(1000, ""), (1001, None), (None, "zorgul")], "doc_id long, text string"), spark.createDataFrame(labels + [(3, None), (None, 1)], "doc_id long, toxic int")


def test_toxicity_held_out(spark, empty):
    docs, labels = labelled(spark)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert len(held) > 40 and all(r.predicted == int(r.doc_id % 4 == 0) for r in held)
    assert got[None].predicted == 1 and not got[None].held_out and got[1000].predicted == got[1001].predicted == 0
    assert toxicity.toxicity(empty, labels).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.5}


def test_toxicity_tolerates_inserted_characters(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    score = lambda t: model.probability(model.worst([t]))[0]
    assert min(score(t) for t in ("a zorgul b", "z o r g u l", "zor.gul", "zorrgul", "ZÖRGUL!", "x" * 30_000 + " wubbex")) >= 0.5 > max(score(t) for t in ("plain", "", " ", "zo. rgul zorn"))


def test_toxicity_of_two_words_that_are_harmless_alone(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklm", k=rng.randint(3, 7))) for _ in range(200)]
    docs, labels = [], []
    for k in range(600):
        text = rng.choices(words, k=25) + rng.choices(["soft", "potato", "old", "lantern"], k=2)
        rng.shuffle(text)
        text = [w for n, w in enumerate(text) if (text[n - 1], w) not in {("soft", "potato"), ("old", "lantern")}]
        if k % 4 == 0:
            at = rng.randint(0, 20)
            text[at:at] = rng.choice([["soft", "potato"], ["old", "lantern"]])
        docs.append((k, " ".join(text)))
        labels.append((k, int(k % 4 == 0)))
    got = toxicity.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).where("held_out").collect()
    toxic = [r.predicted for r in got if r.doc_id % 4 == 0]
    assert len(toxic) > 20 and np.mean(toxic) > 0.9 and np.mean([r.predicted for r in got if r.doc_id % 4]) < 0.1


def brute_strings(text):
    """Words, and pairs of neighbours in a sentence, as strings of symbols."""
    out = []
    for sentence in re.split(r"[.!?](?=\s|$)|\n", text.lower()):
        words = [w for w in (re.sub(r"[^a-z0-9]", "", x) for x in sentence.split()) if w]
        out += [w[k : k + toxicity.PIECE] for w in words for k in range(0, len(w), toxicity.PIECE)] + [f"{a} {b}" for a, b in zip(words, words[1:]) if max(len(a), len(b)) <= toxicity.PIECE]
    return out


def brute_features(s):
    out, total = Counter(), 0.0
    for i in range(len(s)):
        for j in range(i + 1, len(s)):
            for k in range(j + 1, min(len(s), i + toxicity.SPAN)):
                out[s[i], s[j], s[k]] += toxicity.DECAY ** (k - i + 1)
                total += toxicity.DECAY ** (2 * (k - i + 1))
    return out, total**0.5


def test_subsequence_kernel_and_scores_are_exact():
    def kernel(s, t):
        (a, x), (b, y) = brute_features(s), brute_features(t)
        return sum(a[u] * b[u] for u in a) / x / y

    space = toxicity.Landmarks([toxicity.string_of(t) for t in ("banana", "cabin")])
    names = ["bandana", "cab", "wor thless", "aaaaaaaaaaaaaa"]
    got = space.kernel([toxicity.string_of(t) for t in names])
    assert np.allclose(got, [[kernel(t, "banana"), kernel(t, "cabin")] for t in names], atol=1e-5)
    rng = np.random.default_rng(1)
    model = toxicity.Model(rng.normal(size=64**3).astype(np.float32), 0.3, 1.0, 0.0)
    code = {c: k for k, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789")} | {" ": 63}

    def worst(text):
        scores = [0.0]
        for n, s in enumerate(brute_strings(text)):
            f, norm = brute_features(s)
            value = sum(v * model.weights[(code[a] * 64 + code[b]) * 64 + code[c]] for (a, b, c), v in f.items()) / norm if norm else 0.0
            scores = [value] if not n else [*scores, value]
        return max(scores) + 0.3

    texts = ["One two-three, four. Five six", "", "a", "ab cd. ef", "no\nline breaks!Here", "w" * 20 + "x1", "the end ."]
    assert np.allclose(model.worst(texts), [worst(t) for t in texts], atol=1e-4)


def test_weak_quality(spark, empty):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8)))
    good = [" ".join(word() + ("," if k % 7 == 3 else "") for k in range(80)) + "." for _ in range(120)]
    bad = [" ".join(word() + rng.choice("#$%&*") for _ in range(80)) for _ in range(15)] + [" ".join([word()] * 60) for _ in range(15)]
    data = [(k, t) for k, t in enumerate(good + bad)] + [(900, None), (901, ""), (None, good[0])]
    got = {r.doc_id: r for r in weak_quality.weak_quality(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert all(got[k].keep for k in range(120)) and not any(got[k].keep for k in range(120, 150)) and got[None].keep
    assert weak_quality.weak_quality(empty).count() == 0


def test_toxicity_fit_memory():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(20_000)]
    texts = [" ".join(rng.choices(words, k=400)) + " zorgul" * (k % 10 == 0) for k in range(600)]
    tracemalloc.start()
    toxicity.fit(texts, [int(k % 10 == 0) for k in range(600)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 55 * sum(map(len, texts))  # 65 and more where every array of the fit stays


def test_toxicity_fit_releases_what_other_operators_keep():
    tokens.shared().encode("some words of a text")
    common.powers(np.uint64(3), 100)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["plain words", "zorgul"], "toxic": [0, 1]})
    assert len(list(toxicity._fit_rows(iter([batch])))) == 1 and not tokens._shared and 3 not in common._powers


def test_mix_counts_words_and_shuffles_texts_once(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{tmp_path}/docs")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are not small
    try:
        plan = mixing.mix(spark.read.parquet(f"{tmp_path}/docs"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "regexp_count" not in plan  # mixture() has counted them
    window = next(line for line in plan.split("\n") if "Window [" in line)
    after = plan[plan.index(window) :].split("\n")[1:3]
    assert not any("Exchange" in line for line in after), plan  # the join's partitioning serves equal rows too

    same = [(None, "a b c", "x"), (None, "d e f", "x"), (7, "g h i", "x"), (7, "g h i", "x"), (7, "j k l", None), (8, None, None), (8, "", None)]
    docs = spark.createDataFrame(same, "doc_id long, text string, source string")
    want, got = mixing.mixture(docs).collect(), mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.size) for r in want for _ in range(r.copies)) == Counter((r.doc_id, len((r.text or "").split())) for r in got)
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, mixing.mix(docs.orderBy(F.desc("text"))).collect()))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    data = [r for r in rows() if r[0] is not None]
    folder = str(tmp_path)
    spark.createDataFrame(data, SCHEMA).drop("kept", "size").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 0, 0) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    near = spark.read.parquet(f"{folder}/near_dedup")
    assert near.select("doc_id").distinct().count() == near.dropDuplicates().count()
    assert corpus_pipeline.run(spark, folder).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_near_stage_links_from_80_percent(spark, tmp_path):
    import corpus_pipeline

    w = [f"w{k}" for k in range(104)]
    pair = [(1, " ".join(w)), (2, " ".join(w[:50] + ["other", "words"] + w[52:]))]  # 94 shingles of 106 in all: 0.887
    far = [(3, " ".join("a" + x for x in w[:64])), (4, " ".join("a" + x for x in w[:58]) + " tail of six words of its own")]
    x, y = (shingles(t) for _, t in far)
    assert 0.80 <= len(x & y) / len(x | y) < 0.85
    docs = spark.createDataFrame(pair + far, "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.near_out(spark, docs, "").orderBy("doc_id").collect()] == [1, 3]
    assert sorted(r.component_id for r in minhash.near_dedup(docs).collect()) == [1, 1, 3, 4]


def test_pipeline_stages_decide_row_by_row(spark, tmp_path):
    """Repeated and null ids: every row of a doc_id is judged by its own text, and one of equal rows stays."""
    import corpus_pipeline

    docs, labels = labelled(spark)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    mixed = docs.unionByName(spark.createDataFrame([(1, "a zorgul b"), (None, "plain"), (None, None)], "doc_id long, text string"))
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.toxic_out(spark, mixed, str(tmp_path)).collect())
    assert not any("zorgul" in (t or "") for _, t in kept) and kept[(None, "plain")] == kept[(None, None)] == 1 and any(i == 1 for i, _ in kept)

    rng = random.Random(9)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(40))
    a, b, c, d = (text() for _ in range(4))
    schema = "doc_id long, text string, lang string"
    rows_ = [(3, a, "en"), (7, a.replace(" ", "  ", 1), "en"), (7, b, "en"), (7, b, "de"), (None, c, "en"), (None, c, "en"), (None, d, None), (9, d, "en"), (None, None, "en"), (None, "", "en")]
    got = corpus_pipeline.exact_out(spark, spark.createDataFrame(rows_, schema), "").collect()
    assert Counter((r.doc_id, r.text or "") for r in got) == Counter([(3, a), (7, b), (None, c), (9, d), (None, "")])

    rows_ = [(3, a, "en"), (7, a + " x", "en"), (7, b, "en"), (7, b, "de"), (7, b + " y", "en"), (8, b + " y", "en"), (None, c, "en"), (None, c + " z", "en"), (None, d, None), (None, None, "en")]
    got = corpus_pipeline.near_out(spark, spark.createDataFrame(rows_, schema), "").collect()
    assert len(got) == 5 and Counter((r.doc_id, (r.text or "")[:200].split(" ")[0]) for r in got) == Counter([(3, a.split(" ")[0]), (7, b.split(" ")[0]), (None, c.split(" ")[0]), (None, d.split(" ")[0]), (None, "")])


def feistel(left, right, a, b, key, tag):
    for i in range(8):
        known = right if i % 2 == 0 else left
        value = int(hmac.new(key, f"{tag}|{i}|{known}".encode(), "sha256").hexdigest()[:15], 16)
        left, right = ((left + value % a) % a, right) if i % 2 == 0 else (left, (right + value % b) % b)
    return left, right


def test_pseudonyms_against_brute_force(spark):
    key = b"another key"
    got = pseudonyms.pseudonymise(spark.createDataFrame([(1, "4111-1111-1111-1111"), (2, "310-555-4510"), (3, "2001-02-03"), (4, "10.0.0.255")], "doc_id long, text string"), key.decode()).orderBy("doc_id").collect()
    l, r = feistel(4111111, 11111111, 10**7, 10**8, key, "card:16")
    payload = f"{l:07}{r:08}"
    total = sum(sum(divmod(int(c) * 2, 10)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(payload)))
    card = payload + str(-total % 10)
    assert got[0].text == "-".join(card[k : k + 4] for k in range(0, 16, 4))
    l, r = feistel(31055, 54510, 10**5, 10**5, key, "phone:10")
    digits = f"{l:05}{r:05}"
    assert got[1].text == f"{digits[:3]}-{digits[3:6]}-{digits[6:]}"
    day = (date(2001, 2, 3) - date(1900, 1, 1)).days
    l, r = feistel(day // 229, day % 229, 319, 229, key, "day:0")
    assert got[2].text == str(date(1900, 1, 1) + timedelta(l * 229 + r))
    l, r = feistel(10 * 256, 255, 65536, 65536, key, "ip:0")
    assert got[3].text == f"{l // 256}.{l % 256}.{r // 256}.{r % 256}"


def test_queries_without_sql(spark, tmp_path):
    """op1, op2, op6 and op7 over a folder of tables, against the plain computation on each text."""
    docs = spark.createDataFrame(rows(), SCHEMA).drop("kept", "size")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 0, int(k % 5 == 0)) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    texts = [(r[0], r[1] or "") for r in rows()]
    count = lambda t: len(tokens.Pieces().full.encode(t, add_special_tokens=False).ids)

    def edited(t):
        n = len(t)
        for at, gone, new in ((n // 2, 0, " inserted"), (n // 3, 10, ""), (0, 3, "A new start")):
            t = t[:at] + new + t[at + gone :]
        return t

    got = queries.op7_edit_counts(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_tokens_edited) for r in got) == Counter((i, count(t), count(edited(t))) for i, t in texts)
    sums = defaultdict(int)
    for r in queries.op6_packing(spark, str(tmp_path)).collect():
        sums[r.doc_id] += r.length
    want = defaultdict(int)
    for i, t in texts:
        want[i] += count(t) + 1
    assert sums == want
    model = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    got = queries.op1_toxicity(spark, str(tmp_path)).collect()
    score = {t: float(model.probability(model.worst([t]))[0]) for _, t in texts}
    assert sorted((as_id(r.doc_id), round(r.score, 9)) for r in got) == sorted((as_id(i), round(score[t], 9)) for i, t in texts)
    assert all(r.predicted == int(r.score >= 0.5) and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    patterns = Counter()
    one = {}
    for _, t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        bounds = np.array([0, len(data)])
        one[t] = int(weak_quality.pattern_of(weak_quality.votes(weak_quality.measures(data, bounds, common.Words(data, bounds, fold=True))))[0])
        patterns[one[t]] += 1
    keys = np.array(sorted(patterns))
    posterior = dict(zip(keys.tolist(), weak_quality.expectation_maximisation(keys, np.array([float(patterns[k]) for k in keys.tolist()]))[0].tolist()))
    got = queries.op2_weak_quality(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.pattern, round(r.posterior, 9)) for r in got) == Counter((i, one[t], round(posterior[one[t]], 9)) for i, t in texts)
    assert all(r.keep == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
