"""Operators against brute force, exact round trips and held-out accuracy."""

import collections
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SMALL
from tests.llm import cases
from tonelab.llm import components, embeddings, language, lines, packing, queries, rows, simhash, spans, suffix_tree, templates, tokens


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in rows.table(spark, SMALL, "documents").collect()}


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)] + [(500, 500 + i) for i in range(1, 50)]
    links = spark.createDataFrame([*pairs, (None, 3), (7, 7)], "u bigint, v bigint")
    near = collections.defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    nodes = {x for p in pairs for x in p if any(a != b and x in (a, b) for a, b in pairs)}
    want = cases.groups(nodes, lambda a, b: b in near[a])
    assert {r["node"]: r["component"] for r in components.components(links).collect()} == want


def test_op1_base_and_gain(spark, docs):
    got = {r["doc_id"]: r for r in queries.op1_lm_scoring(spark, SMALL).collect()}
    split = {d: [*t.encode().lower().split(), b""] for d, t in docs.items()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in docs}
    counts = collections.Counter(w for d, t in split.items() if not held[d] for w in t)
    n, mass = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    for d, words in split.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(words), sum(w in counts for w in words), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / mass) for w in words))
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def tree_score(train, text, depth, least_context, least_pair, gain):
    """The suffix tree by dictionaries, and the log10 probability of a text."""
    split = [[*t.split(), ""] for t in train]
    base = collections.Counter(w for t in split for w in t)
    mass = sum(base.values()) + 0.5 * (len(base) + 1)
    after = collections.defaultdict(collections.Counter)
    for t in split:
        for i in range(len(t)):
            for k in range(1, min(depth, i) + 1):
                after[tuple(t[i - k : i])][t[i]] += 1
    kept = {}

    def prob(context, word):
        if not context:
            return (base[word] + 0.5) / mass
        total, rest, seen = kept[context]
        return (max(seen[word] - 0.75, 0) / total if word in seen else 0) + rest * prob(context[1:], word)

    for context in sorted(after, key=len):
        total = sum(after[context].values())
        if total < least_context or (len(context) > 1 and context[1:] not in kept):
            continue
        seen = {w: n for w, n in after[context].items() if n >= least_pair}
        rest = 1 - sum(n - 0.75 for n in seen.values()) / total
        below = {w: prob(context[1:], w) for w in seen}
        left = {w: n for w, n in seen.items() if n > least_pair}
        won = sum(n * math.log((n - 1.75) / (total - 1) / below[w] + rest) for w, n in left.items())
        if seen and won + (total - sum(left.values())) * math.log(rest) >= gain:
            kept[context] = (total, rest, seen)
    words, out = [*text.split(), ""], 0.0
    for i, w in enumerate(words):
        context = next((c for c in (tuple(words[i - k : i]) for k in range(min(depth, i), 0, -1)) if c in kept), ())
        out += math.log10(prob(context, w))
    return out, len(kept)


@pytest.mark.parametrize("head", [1 << 20, 8])
def test_suffix_tree(spark, head):
    """With all terms in the tasks, and with nearly all of them shuffled."""
    rng = np.random.default_rng(2)
    follow = rng.integers(0, 12, (12, 12, 3))
    texts = []
    for _ in range(60):
        t = [0, 1]
        for _ in range(80):
            t.append(int(rng.choice(follow[t[-2], t[-1]])) if rng.random() < 0.8 else int(rng.integers(0, 12)))
        texts.append(" ".join(f"w{x}" for x in t))
    table = cases.plain(spark, dict(enumerate(texts)))
    got = suffix_tree.score(table, table.where("doc_id < 45"), min_context=20, head=head).collect()
    for r in got:
        want, states = tree_score(texts[:45], texts[r["doc_id"]], suffix_tree.DEPTH, 20, suffix_tree.MIN_PAIR, suffix_tree.GAIN)
        assert states > 12 and r["score"] == pytest.approx(want)


def test_op2(spark):
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in rows.table(spark, SMALL, "embeddings").collect()}
    ids = sorted(vectors)
    unit = np.stack([vectors[i] / np.linalg.norm(vectors[i]) for i in ids])
    linked = unit @ unit.T >= 0.9
    at = {v: i for i, v in enumerate(ids)}
    want = cases.groups(ids, lambda a, b: linked[at[a], at[b]])
    for tile in (embeddings.TILE, 32):  # one tile, and many
        got = embeddings.near_duplicates(rows.table(spark, SMALL, "embeddings"), tile=tile).collect()
        assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {v: (int(linked[at[v]].sum()) - 1, want[v]) for v in ids}


def test_op3_reparameterised(spark):
    item = "A train with 12 wagons leaves the station of Bern at noon and runs 80 km to the lake near Thun where 12 people wait"
    texts = {
        1: "Before it. " + item.replace("12", "31").replace("80", "95").replace("Bern", "Wien").replace("Thun", "Graz") + " and more.",
        2: "Before it. " + item.replace("12", "31", 1).replace("Bern", "Wien"),  # 12 becomes 31 and 12
        3: item,
        4: "A bus with 12 seats leaves the yard of Bern at dawn and takes 80 l to the hill near Thun where 12 cows graze",
    }
    found = templates.contaminated(cases.plain(spark, texts), spark.createDataFrame([(7, item)], "item_id int, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["same_values"]) for r in found} == {(1, 7, False), (3, 7, True)}


def test_op3_finds_every_item(spark, docs):
    """All documents that hold an item word for word, and no others, on the given tables."""
    plain = lambda t: [w for w in (x.strip(templates._EDGES).lower() for x in t.split()) if w]
    grams = collections.defaultdict(set)
    for r in rows.table(spark, SMALL, "benchmark").collect():
        words = plain(r["text"])
        for i in range(len(words) - 12):
            grams[tuple(words[i : i + 13])].add(r["item_id"])
    want = {(d, i) for d, t in docs.items() for w in [plain(t)] for k in range(len(w) - 12) for i in grams.get(tuple(w[k : k + 13]), ())}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op3_benchmark_decontamination(spark, SMALL).collect()}
    assert got == want and want


def test_op4(spark):
    docs = {r["doc_id"]: r for r in rows.table(spark, "/root/testdata/sf0.01", "documents").collect()}
    got = queries.op4_language_id(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(docs) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_vectors():
    one = language.text_vectors(["Das Tier"], 64)[0]
    grams = [" da", "das", "as ", "s t", " ti", "tie", "ier", "er "]
    letter = lambda c: language._letter_vector(ord(c), 64).astype(int)
    want = sum(np.roll(letter(g[0]), 2) * np.roll(letter(g[1]), 1) * letter(g[2]) for g in grams)
    assert (one == want).all()
    assert (language.text_vectors(["a b" * 5], 64) == language.text_vectors(["A  B" * 5], 64)).all()


def plain_cut(text):
    """Sentences as lists of (word, start, end), by the rules told one after the other."""
    out = []
    for line in re.finditer(rb"[^\n]+", text):
        words = [(m.group().translate(LOWER), line.start() + m.start(), line.start() + m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", line.group())]
        sentence = []
        for w in words:
            sentence.append(w)
            if re.search(rb"[.!?][\"')]*$", w[0]) or w is words[-1]:
                hashes = [xxhash.xxh64_intdigest(x[0]) for x in sentence]
                part = []
                for i, x in enumerate(sentence):
                    part.append(x)
                    last = hashes[max(0, i - 7) : i + 1]
                    cut = hashes[i] % 3 == 0 or (i >= 7 and all(h % 3 for h in last) and hashes[i] == min(last))
                    if i == len(sentence) - 1 or (len(sentence) > 8 and cut):
                        out.append(part)
                        part = []
                sentence = []
    return out


LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def brute_spans(texts):
    """Texts without the sentences under a run of words that occurred before, and how many went."""
    seen, out = set(), {}
    for d in sorted(texts):
        raw = texts[d].encode()
        cut, gone = plain_cut(raw), set()
        for a in range(len(cut)):
            z = a + 3
            while z <= len(cut) and sum(map(len, cut[a:z])) < 24:
                z += 1
            if z <= len(cut):
                run = tuple(tuple(x[0] for x in s) for s in cut[a:z])
                gone |= set(range(a, z)) if run in seen else set()
                seen.add(run)
        kept, at = b"", 0
        for i in sorted(gone):
            if i and i - 1 in gone:
                kept_until = cut[i][-1][2]
                kept, at = kept + raw[at : cut[i][0][1]], kept_until
            else:
                kept, at = kept + raw[at : cut[i][0][1]], cut[i][-1][2]
        out[d] = (kept + raw[at:], len(gone))
    return out


@pytest.mark.parametrize("limit", [rows.BROADCAST_ROWS, 0])
def test_op5(spark, docs, limit):
    got = spans.drop_repeated_spans(cases.plain(spark, docs), limit=limit).collect()
    assert {r["doc_id"]: (r["text"].encode(), r["n_removed"]) for r in got} == brute_spans(docs)


def test_op5_finds_shared_passages(spark):
    rng = np.random.default_rng(4)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n))
    for passage in (words(55), ". ".join(words(9) for _ in range(6))):
        texts = {i: f"{words(40)} {passage} {words(40)}" for i in range(4)} | {i: words(130) for i in range(4, 8)}
        got = {r["doc_id"]: r for r in spans.drop_repeated_spans(cases.plain(spark, texts)).collect()}
        assert [got[i]["n_removed"] > 0 for i in range(8)] == [False, True, True, True] + [False] * 4
        assert all(len(got[i]["text"].split()) < 115 for i in (1, 2, 3))


def test_op5_finds_passages_of_few_words(spark):
    """One word, a pattern of words of which none is chosen, rows of equal cells; between random words."""
    rng = np.random.default_rng(11)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n))
    unchosen = [w for w in map("w{}".format, range(200)) if xxhash.xxh64_intdigest(w.encode()) % 3]
    passages = [" ".join([w] * 57) for w in unchosen[:3]] + [" ".join(unchosen[a : a + p] * (60 // p)) for a, p in ((5, 2), (9, 3), (20, 5), (40, 12))]
    for passage in passages:
        texts = {i: f"{words(40)} {passage} {words(40)}" for i in range(3)}
        got = {r["doc_id"]: r["n_removed"] > 0 for r in spans.drop_repeated_spans(cases.plain(spark, texts)).collect()}
        assert got[1] and got[2]  # a pattern may repeat in the first text as well


@pytest.mark.parametrize("limit", [rows.BROADCAST_ROWS, 0])
def test_op6_brute(spark, limit):
    base = "abcdefghijklmnopqrstuvwxyz"
    near = [base, base[1:], base[:-1], base[:7] + "Z" + base[8:], base[:9] + "!" + base[9:], "Z" + base, base[:5] + "XY" + base[7:], base[:19], base[:18] + "Q"]
    texts = {10: "\n".join(near[:4]), 11: "\n".join(near[4:]), 12: base + "\n  " + base + "\t\nnew line of its own here\nab\nab", 13: "ac\nnew line of its 0wn here"}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        return out

    before, want = [], {}
    for d in sorted(texts):
        kept = []
        for raw in texts[d].split("\n"):
            line = raw.strip(" \t\r")
            close = lambda p, line=line: p == line or (min(len(p), len(line)) >= 20 and edits(p, line) <= 1)
            if not any(map(close, before)):
                kept.append(raw)
            before.append(line)
        want[d] = "\n".join(kept)
    got = lines.drop_repeated_lines(cases.plain(spark, texts), limit=limit).collect()
    assert {r["doc_id"]: r["text"] for r in got} == want


def test_op7(spark, docs):
    def brute(text):
        words = text.encode().lower().split()
        cut = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
        hashes = [xxhash.xxh64_intdigest(c, 42) for c in cut] if words else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    want = {d: brute(t) for d, t in docs.items()}
    group = cases.groups(want, lambda a, b: (want[a] ^ want[b]).bit_count() <= 4)
    got = queries.op7_simhash_near_dedup(spark, SMALL).collect()
    assert {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in got} == {d: (want[d], group[d]) for d in docs}


def test_covering_masks():
    rng = np.random.default_rng(3)
    for radius in (1, 4):
        masks = simhash.covering_masks(radius)
        for _ in range(2000):
            differing = sum(1 << int(b) for b in rng.choice(64, radius, False))
            assert any(not differing & m for m in masks)


def test_links_in_blocks(spark):
    """Split buckets connect what one bucket connects."""
    rng = np.random.default_rng(5)
    base = int(rng.integers(1 << 62))
    fps = sorted({base ^ sum(1 << int(b) for b in rng.choice(40, rng.integers(0, 6), False)) for _ in range(300)})
    table = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    want = cases.groups(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    for block in (simhash.BLOCK, 16):
        found = components.components(simhash.links(table, 4, block)).collect()
        got = {f: f for f in fps} | {r["node"]: r["component"] for r in found}
        assert got == want


def test_op8_round_trip(spark, docs):
    tokenizer = packing.encoder(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    want = {d: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4") for d, t in docs.items()}
    pieces = queries.op8_packing(spark, SMALL).collect()
    upto = collections.Counter()
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        ids = want[p["doc_id"]]
        assert p["start"] == upto[p["doc_id"]] and p["doc_tokens"] == len(ids)
        assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
        upto[p["doc_id"]] += p["length"]
    assert upto == {d: len(ids) for d, ids in want.items()}
    held = collections.defaultdict(list)
    for p in pieces:
        held[p["sequence_id"]].append((p["offset"], p["length"]))
    padded = 0
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        padded += 0 if at & (at - 1) == 0 else 2048 - at
    assert padded == 0


TRICKY = st.text(st.sampled_from("aB'sté0.,!?-<|>Σς́ \n\x1c ß中"), max_size=40)


@settings(max_examples=200, deadline=None)
@given(TRICKY)
def test_words_encode_like_texts(text):
    code = packing.encoder(public_tokenizers.path("word_bpe_49k.json"))
    ids = code.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(code.encode(text.encode()), "<u4").tolist() == ids


def brute_count(vocabulary, word):
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            piece = word[start:end]
            score, n = vocabulary.score.get(piece), 1
            if score is None and end - start == 1:
                n = len(piece.encode())
                score = n * vocabulary.byte
            if score is not None and (best[start][0] + score, -best[start][1] - n) > (best[end][0], -best[end][1]):
                best[end] = (best[start][0] + score, best[start][1] + n)
    return best[-1][1]


def test_op10(spark, docs):
    vocabulary = tokens.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    words = {w for t in docs.values() for w in t.split()}
    counted = {w: brute_count(vocabulary, tokens.START + w) for w in words}
    got = queries.op10_token_counts(spark, SMALL).collect()
    assert {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in got} == {d: (len(t.split()), sum(counted[w] for w in t.split())) for d, t in docs.items()}
