"""The ten training-data operators and the pipeline against brute force, round trips and planted cases on small tables."""

import hashlib
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import chat, decontaminate, fingerprint, ngram_join, packing, pii, quality, secrets, substring_dedup, toxicity
from graphloom.llm.automaton import SuffixAutomaton
from graphloom.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Names that operators use inside, as extra columns of an input.
CLASHING = ["node", "key", "label", "offset", "n", "part", "rank", "_text", "_hits", "postings", "secret_spans", "quality_score", "cluster", "copy", "bits", "_kept"]


def make(spark, texts, first=0):
    rows = [(first + k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    """Texts with exact and near copies, a hot line, shared passages, nulls, empty and long texts."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgéñ") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = [None, "", " \n\t ", "one", "One", "one two three four", "a b c d e"]
    base, passage, line = words(120), words(30), "The very same LINE stands in most of these texts here"
    for k in range(60):
        body = words(rng.choice([5, 12, 13, 14, 60, 150]))
        if k % 3 == 0:
            body[2:2] = line.split()
        if k % 7 == 0:
            body[1:1] = passage
        texts.append(" ".join(body) + ("\n" if k % 2 else ""))
    for k in range(25):
        near = list(base)
        for _ in range(k % 6):
            near[rng.randrange(len(near))] = rng.choice(vocabulary)
        texts.append("  ".join(near))
    texts += [texts[10]] * 4 + [" ".join(words(5000))]
    rng.shuffle(texts)
    return texts


def test_automaton_matching_statistics():
    rng = random.Random(1)
    for _ in range(30):
        items = [[rng.randrange(3) for _ in range(rng.randint(1, 9))] for _ in range(4)]
        automaton = SuffixAutomaton(items)
        known = {tuple(i[a:b]) for i in items for a in range(len(i)) for b in range(a + 1, len(i) + 1)}
        text = [rng.randrange(4) for _ in range(30)]
        for k, (_, n) in enumerate(automaton.walk(text)):
            assert n == max(m for m in range(k + 2) if m == 0 or tuple(text[k + 1 - m : k + 1]) in known)


def test_packing(spark, corpus):
    rows = packing.pack_documents(make(spark, corpus), keep_ids=True).collect()
    encode = packing._encoder(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    for odd in ("a<|endoftext|> b", "日本 x", "é ß  y", ""):
        assert encode(odd).tolist() == plain.encode(odd, add_special_tokens=False).ids
    whole, used = {}, {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        ids = whole.setdefault(r["doc_id"], [])
        assert r["start"] == len(ids) and r["length"] == len(r["ids"]) <= 2048
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        ids += r["ids"]
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for k, t in enumerate(corpus):
        assert whole[k] == [*plain.encode(t or "", add_special_tokens=False).ids, 0]
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(used) <= -(-sum(map(len, whole.values())) // 2048) + 1
    sequence = packing.sequences(packing.pack_documents(make(spark, corpus), keep_ids=True)).collect()
    assert sum(len(s["ids"]) for s in sequence) == sum(map(len, whole.values()))


def test_packing_plan_is_whole_and_tight():
    rng = random.Random(3)
    for _ in range(200):
        capacity = rng.choice([7, 20, 100])
        counts = {rng.randint(1, capacity): rng.randint(1, 9) for _ in range(rng.randint(1, 9))}
        bins, seen = {}, {}
        for r in packing.plan_runs(counts, capacity):
            for j in range(r.count):
                bins.setdefault(r.sequence + j // r.per_bin, []).append((r.offset + j % r.per_bin * r.length, r.length))
                seen.setdefault(r.length, set()).add(r.first + j)
        assert {k: len(v) for k, v in seen.items()} == counts
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        simple = []
        for n in sorted((k for k, c in counts.items() for _ in range(c)), reverse=True):
            fit = min((b for b in simple if b >= n), default=None)
            if fit is None:
                simple.append(capacity - n)
            else:
                simple[simple.index(fit)] -= n
        assert len(bins) <= len(simple) + 1


def brute_decontaminate(texts, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = [(k, tuple(w[p : p + min(10, len(w))])) for k, t in items for w in [split(t)] if w for p in range(len(w) - min(10, len(w)) + 1)]
    out = []
    for t in texts:
        w = split(t)
        hit, found = set(), set()
        for k, g in windows:
            for p in range(len(w) - len(g) + 1):
                if tuple(w[p : p + len(g)]) == g:
                    hit |= set(range(p, p + len(g)))
                    found.add(str(k))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("shard_words", [200_000, 20])
def test_decontamination(spark, shard_words, monkeypatch):
    monkeypatch.setattr(decontaminate, "TOGETHER", 2)
    rng = random.Random(2)
    word = lambda: rng.choice("ab") + rng.choice(["", "é", "0"])
    items = [(k, " ".join(word() for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 25])))) for k in range(25)] + [(90, None), (91, "...")]
    texts = [None, "", "AÉ"] + [" , ".join(word().upper() for _ in range(rng.choice([0, 2, 10, 40]))) for _ in range(30)] + [f"x {t} y" for _, t in items]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(make(spark, texts), bench, shard_words=shard_words).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in got] == brute_decontaminate(texts, items)
    kept = decontaminate.decontaminate(make(spark, ["clean words stay as they are", None]), bench.where("item_id < 0")).orderBy("doc_id").collect()
    assert [r["text"] for r in kept] == ["clean words stay as they are", None]


def test_spans_are_cut_and_covered_documents_go(spark):
    bench = spark.createDataFrame([(1, " ".join(f"q{k}" for k in range(12)))], "item_id long, text string")
    passage = " ".join(f"Q{k}" for k in range(12))
    rows = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(make(spark, [f"{'good ' * 20}{passage}, end.", passage, "fine"]), bench).collect()}
    assert rows == {0: "good " * 20 + ", end.", 2: "fine"}


def brute_dedup(texts):
    words = [(t or "").encode().split() for t in texts]
    first, out = {}, []
    for k, w in enumerate(words):
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), k)
    for k, w in enumerate(words):
        gone = {q for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < k for q in range(p, p + 13)}
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for q, x in enumerate(w) if q not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("shard_texts", [5000, 2])
def test_substring_dedup(spark, corpus, shard_texts):
    got = substring_dedup.dedup_substrings(make(spark, corpus), shard_texts=shard_texts).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in got] == brute_dedup(corpus)


def test_chat_round_trip_and_order(spark):
    odd = ["</s>[INST] ok [/INST]", "a\\b<\\/s>", "<|im_end|>\n<|im_start|>", "\\", "<", "", None]
    rows = [(c, k, ["user", "assistant"][k % 2], t) for c, t in enumerate(odd) for k in range(2)] + [(50, 0, "assistant", "x"), (50, 1, "a\nb%", "y"), (51, 0, None, None), (None, 0, "user", "z")]
    chats = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    template = chat.Template()
    for r in chats.collect():
        role, text = template.read("".join(s["text"] for s in r["segments"]))
        want = next(x for x in rows if x[0] == r["conv_id"] and x[1] == r["turn"])
        assert (role, text) == (want[2] or "", want[3] or "")
        assert not any(c in s["text"] for s in r["segments"][1:2] for c in template.controls)
    back = {r["conv_id"]: r for r in chat.read_back(chats).collect()}
    assert back[0]["valid"] and not back[50]["valid"] and not back[51]["valid"] and len(back) == 10
    assert back[0]["loss_chars"] == len(odd[0]) and back[0]["loss_sha256"] == hashlib.sha256(odd[0].encode()).hexdigest()


def labelled(spark, n, text_of):
    rng = random.Random(9)
    rows = [(k, *text_of(rng, k)) for k in range(n)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(k, y, y) for k, _, y in rows if k % 3], "doc_id long, quality int, toxic int")
    return docs, labels, {k: y for k, _, y in rows}


def accuracy(scored, name, truth, cut):
    rows = [(r["doc_id"], r[name] >= cut) for r in scored.collect()]
    kept = [(k, p) for k, p in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    assert len(kept) > 50
    return sum(p == bool(truth[k]) for k, p in kept) / len(kept)


def test_toxicity_learns_words_and_stems(spark):
    def text_of(rng, k):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(60)]
        toxic = k % 5 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["vreck", "zoltan" + "".join(rng.choice("xyz") for _ in range(3))])
        return " ".join(words) + ".", int(toxic)

    docs, labels, truth = labelled(spark, 600, text_of)
    assert accuracy(toxicity.score_toxicity(docs, toxicity.fit(docs, labels)), "toxicity_score", truth, 0.7) > 0.97
    grammar = toxicity.Grammar()
    kinds = lambda t: {k for k, _ in grammar.clause(t.split())}
    assert kinds("you are a stupid person") == {"aimed"} and kinds("what a stupid little thing to leave there you") == {"plain"}
    assert kinds("he is not stupid") == {"negated"} and kinds("she said stupid things") == {"reported"}
    assert grammar.matched("A fine day. Nothing here!") == []
    none = toxicity.fit(docs, labels.limit(0))
    assert all(0 <= r["toxicity_score"] <= 1 for r in toxicity.score_toxicity(make(spark, [None, "", "idiot"]), none).collect())


def weight(grammar, text):
    return sum(w for _, found in grammar.matched(text) for _, w in found)


def test_toxicity_composes_its_transducers():
    grammar = toxicity.Grammar()
    plain, aimed = weight(grammar, "a stupid thing of old"), weight(grammar, "you are stupid")
    assert 0 < weight(grammar, "you are not stupid") < aimed and 0 < weight(grammar, "the paper wrote: stupid things") < plain < aimed
    assert weight(grammar, "kill the lights and go") == 0 < weight(grammar, "we kill them") < weight(grammar, "we will kill them")
    # a target after the insult redeems the guess, one too far away doesn't
    assert weight(grammar, "stupid people like you") == aimed and weight(grammar, "stupid as ever is the weather for you") == plain
    # the composition accepts what its parts accept one after another
    rng = random.Random(3)
    machines = [toxicity.reported_speech(0.5)]
    for make in (lambda a: toxicity.negation(a, 0.4), lambda a: toxicity.targets(a, 1.5), lambda a: toxicity.threats(a, 1.0), toxicity.insults):
        machines.append(make(machines[-1].outputs))
    for _ in range(300):
        text = [rng.randrange(7) for _ in range(rng.randint(0, 9))]
        paths = [((0,) * len(machines), 0.0, ())]
        for symbol in text:
            after = []
            for states, total, marks in paths:
                step = [(symbol, 1.0, ())]
                for machine, state in zip(machines, states, strict=True):
                    step = [(out, f * g, (*done, to)) for middle, f, done in step for out, g, to in machine.arcs[state].get(middle, ())]
                after += [(to, total + f * (symbol in (1, 2)), (*marks, out) if symbol in (1, 2) else marks) for out, f, to in step]
            paths = after
        totals = [t for states, t, _ in paths if all(s in m.final for m, s in zip(machines, states, strict=True))]
        got = grammar.machine.best([(s, float(s in (1, 2))) for s in text])
        assert abs(sum(w for _, w in got) - max(totals)) < 1e-9


def test_toxicity_factors_come_from_labels(spark):
    rng = random.Random(4)
    rows = []
    for k in range(1200):
        kind = rng.choice(["plain", "negated", "none"])
        text = {"plain": "a stupid thing", "negated": "it is not stupid", "none": "a fine thing"}[kind]
        rows.append((f"{text} number {'x' * (k % 7)}.", int(rng.random() < {"plain": 0.9, "negated": 0.1, "none": 0.05}[kind])))
    learnt = toxicity.learn_factors(toxicity.Grammar(), spark.createDataFrame(rows, "text string, label int"))
    assert learnt.factors["negated"] < toxicity.FACTORS["negated"] and learnt.factors["reported"] == toxicity.FACTORS["reported"]


def test_quality_from_positive_and_unlabelled(spark):
    def text_of(rng, k):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(10, 80))]
        if k % 5 == 0:
            words = [rng.choice(words) + rng.choice(["$$$", "###"]) for _ in words] if k % 2 else [words[0]] * len(words)
        return " ".join(words) + ".", int(k % 5 != 0)

    docs, labels, truth = labelled(spark, 900, text_of)
    model = quality.fit(docs, labels)
    assert 0.7 < model.prior < 0.9
    assert len(quality.positives_of(docs, labels.where("quality = 0"))) == 0 and quality.fit(docs, labels.where("quality = 1")).weights.tolist() == model.weights.tolist()
    assert accuracy(quality.score_quality(docs, model), "quality_score", truth, 0.5) > 0.95
    scores = [r["quality_score"] for r in quality.score_quality(make(spark, [None, "", "x"]), model).collect()]
    assert scores[0] == scores[1] and all(0 <= s <= 1 for s in scores)
    assert quality.fit(docs, labels.where("quality = 0")) is None


def test_quality_risk_is_that_of_the_rows():
    rng = np.random.default_rng(2)
    p, u = (np.column_stack([rng.integers(0, 2, (n, 5)), np.ones(n)]).astype(float) for n in (40, 90))
    w, a, b = rng.normal(size=6), quality.Moments.of(p), quality.Moments.of(u)
    for m, rows in ((a, p), (b, u)):
        for sign in (1, -1):
            value, gradient = m.squares(w, sign)
            assert np.isclose(value, ((1 + sign * rows @ w) ** 2 / 4).mean())
            assert np.allclose(gradient, (sign * (1 + sign * rows @ w) / 2) @ rows / len(rows))
    risk = lambda w, prior=0.6: prior * a.squares(w, -1)[0] + max(0.0, b.squares(w, 1)[0] - prior * a.squares(w, 1)[0]) + 0.5e-3 * w @ w
    best = quality.minimise(a, b, 0.6)
    assert all(risk(best) <= risk(best + rng.normal(size=6) * 0.05) + 1e-4 for _ in range(200))


def test_fingerprints(spark):
    texts = ["Straße  Café", "STRASSE CAFÉ", "strasse\ncafé ", "other", "other", None, "", "Å", "å"]
    docs = make(spark, texts)
    fps = [r["fingerprint"] for r in fingerprint.with_fingerprint(docs.fillna("", ["text"])).orderBy("doc_id").collect()]
    assert len(set(fps[:3])) == 1 and fps[3] == fps[4] != fps[0] and fps[5] == fps[6] and fps[7] == fps[8]
    groups = {r["doc_id"]: (r["variant"], r["copies"]) for r in fingerprint.fingerprint_groups(docs).collect()}
    assert groups[0] == (0, 3) and groups[3] == (0, 2) and len(groups) == len(texts)
    spread = docs.withColumn("doc_id", F.when(F.col("doc_id") == 8, 10**15).otherwise(F.col("doc_id") * 7)).fillna("", ["text"])
    order = sorted(((r["doc_id"], r["text"]) for r in spread.collect()), reverse=True)
    for rows in (1, 3, 2000):
        got = {r["doc_id"]: r["next_text"] for r in fingerprint.with_next(spread.select("doc_id", "text"), rows).collect()}
        assert got == {k: order[(p + 1) % len(order)][1] for p, (k, _) in enumerate(order)}


def brute_canonical(text):
    nfc = lambda t: unicodedata.normalize("NFC", t)
    return re.sub(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " ", nfc(nfc(text).casefold())).strip(" ")


def test_fingerprint_query_by_brute_force(spark, tmp_path):
    rng = random.Random(21)
    texts = ["".join(rng.choice(["a", "B", " ", "é", "\n", "Σ"]) for _ in range(rng.choice([0, 1, 2, 3, 9]))) for _ in range(120)] + [None, "x" * 40000, "X" * 40000, "same", "Same ", "SAME"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    spark.createDataFrame([(7 * k, t, "en", "s", 0) for k, t in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in fingerprint.op7_document_fingerprints(spark, str(tmp_path)).collect()}
    plain = [t or "" for t in texts]
    assert len(got) == len(plain)
    same: dict = {}
    for k, t in enumerate(plain):
        follow = plain[k - 1] if k else plain[-1]  # the next lower id; after the least comes the highest
        half = len(t) // 2
        edited = t[: len(t) - half] + follow[:half]
        r = got[7 * k]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == float(brute_canonical(t) == brute_canonical(edited)) and r["near_next"] == float(brute_canonical(t) == brute_canonical(follow))
        assert r["copies"] == sum(brute_canonical(u) == brute_canonical(t) for u in plain) and r["variants"] == 1
        assert same.setdefault(brute_canonical(t), r["fingerprint"]) == r["fingerprint"]
    assert len(set(same.values())) == len(same)


def test_fingerprint_collisions_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "wide_hash", lambda text: F.lpad(F.char_length(text).cast("string"), 32, "0"))
    groups = {r["doc_id"]: (r["variant"], r["copies"]) for r in fingerprint.fingerprint_groups(make(spark, ["aa", "bb", "AA", "ccc", "c", None])).collect()}
    assert groups == {0: (0, 2), 2: (0, 2), 1: (1, 1), 3: (0, 1), 4: (0, 1), 5: (0, 1)}


def test_canonical_form_is_normalised_and_folded(spark):
    same = [("\u00ea\u0323", "e\u0302\u0323", "\u1ec7", "e\u0323\u0302"), ("\u1f02\u0345", "\u1f82"), ("\u00e9\u0315", "e\u0315\u0301"), ("ΛΌΓΟΣ", "λόγος", "λο\u0301γοσ"), ("\u1112\u1161\u11ab", "\ud558\u11ab", "\ud55c"), ("\u0390", "\u03aa\u0301")]
    rng = random.Random(9)
    marks = [chr(c) for c in range(0x300, 0x363)] + list("\u0345\u0323\u0fb2\u0f73\u0cc2\u0cd5\u0dca\u0dcf\u1161\u11a8\u0f71\u0344\u05b0\u093c")
    bases = list("aeouAEΑΣσςωΩıİßkKx \u0cc6\u0dd9\u1100\uac00\uac01\u212b\u0958\u1f02\u00ea\U0001d15e\U00011099\u13a0\uab70ﬃ")
    pushed = [x for c in map(chr, [*range(0x300, 0xD800), *range(0x10000, 0x1F000)]) if unicodedata.combining(c) for x in (f"a\u0301{c}z", f"a{c}\u0301z", f"a\u0316{c}")]
    texts = [*sum(same, ()), *pushed, *map(chr, [*range(0x20, 0xD800, 1), *range(0xF900, 0x12000)]), *("".join(rng.choice(marks if rng.random() < 0.6 else bases) for _ in range(rng.randint(1, 9))) for _ in range(3000))]
    got = {r["doc_id"]: r["c"] for r in make(spark, texts).select("doc_id", fingerprint.canonical(F.col("text")).alias("c")).collect()}
    nfc = lambda t: unicodedata.normalize("NFC", t)
    blank = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
    want = [blank.sub(" ", nfc(nfc(t).casefold())).strip(" ") for t in texts]
    assert [(ascii(t), ascii(got[k]), ascii(w)) for k, (t, w) in enumerate(zip(texts, want, strict=True)) if got[k] != w] == []
    at = 0
    for group in same:
        assert len({got[at + k] for k in range(len(group))}) == 1
        at += len(group)


def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [(len(s), find(k)) for k, s in enumerate(sets)]


@pytest.mark.parametrize("block", [4000, 3])
def test_ngram_join(spark, corpus, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    got = ngram_join.near_duplicates(make(spark, corpus)).orderBy("doc_id").collect()
    assert [(r["n_shingles"], r["component_id"]) for r in got] == brute_components(corpus)


def test_ngram_join_of_a_long_chain_in_small_blocks(spark, monkeypatch):
    """Neighbours are alike, ends aren't: most blocks aren't connected with the hub at first."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 4)
    words = [f"w{k}" for k in range(260)]
    texts = [" ".join([*words[3 * k : 3 * k + 60], *["same", "five", "words", "in", "all"]]) for k in range(60)]
    random.Random(4).shuffle(texts)
    texts += [" ".join(f"z{j}" for j in range(9 * k, 9 * k + 40)) for k in range(20)] + texts[:9]
    got = ngram_join.near_duplicates(make(spark, texts)).orderBy("doc_id").collect()
    assert [(r["n_shingles"], r["component_id"]) for r in got] == brute_components(texts)


def test_signature_bounds_lose_nothing():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([rng.permutation(a)[: max(1, int(len(a) * rng.uniform(0.6, 1)))], rng.integers(0, 2**63, int(rng.integers(0, 9))).astype(np.uint64)]))
        trees = [ngram_join.SignatureTree([0], [len(s)], [ngram_join.bitmap(s)]).root for s in (a, b)]
        if ngram_join.similar(a, b):
            assert ngram_join.may_overlap(*trees)
            assert np.intersect1d(a[: ngram_join.prefix_length(len(a))], b[: ngram_join.prefix_length(len(b))]).size


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(20)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(21)} | {100 + k: 100 for k in range(30)}


def test_pii(spark):
    texts = ["Write a.b@c.de, call +49 (30) 1234-5678 now", "ip 10.0.0.255 and 1.2.3.999", "card 4111 1111 1111 1111.", "x@y no", "phone (555) 123-4567 please", "version 1.2.3 of page 12", None, "", "a@b.c@d.e", "1" * 5000, "é 1.2.3.4"]
    rows = pii.find_pii(make(spark, texts)).orderBy("doc_id").collect()
    cut = [[(s["kind"], (t or "")[s["start"] : s["stop"]]) for s in r["base_spans"]] for r, t in zip(rows, texts, strict=True)]
    assert cut[0] == [("email", "a.b@c.de"), ("phone", "+49 (30) 1234-5678")]
    assert cut[1] == [("ip", "10.0.0.255")] and cut[2] == [("card", "4111 1111 1111 1111")]
    assert cut[3] == cut[5] == cut[6] == cut[7] == cut[9] == [] and cut[8] == [("email", "a@b.c")] and cut[10] == [("ip", "1.2.3.4")]
    assert any(s["kind"] == "loose_phone" for s in rows[4]["pii_spans"]) and not rows[5]["pii_spans"]
    red = {r["doc_id"]: r["text"] for r in pii.redact_pii(pii.find_pii(make(spark, texts))).collect()}
    assert red[2] == "card [card]." and red[5] == texts[5] and red[6] == ""
    pattern = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    rng = random.Random(6)
    for _ in range(500):
        t = "".join(rng.choice("ab.@- ") for _ in range(rng.randint(0, 25)))
        assert pii._emails(t) == [m.span() for m in pattern.finditer(t)]


def test_pii_base_spans_by_brute_force():
    def brute(t):
        digits = lambda x: "".join(c for c in x if c in "0123456789")
        found = {k: [(m.span(), m[0]) for m in re.finditer(p, t)] for k, p in (("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))}
        keep = {"ip": lambda x: all(int(p) <= 255 for p in x.split(".")), "card": lambda x: 14 <= len(digits(x)) <= 19 and pii.luhn(digits(x)), "phone": lambda x: 10 <= len(digits(x)) <= 15}
        return {k: [s for s, x in found[k] if keep[k](x)] for k in found}

    rng = random.Random(12)
    for _ in range(6000):
        t = "".join(rng.choice(rng.choice(["0123456789", "01", "+.-() ", "1234", "x+4111 "])) for _ in range(rng.randint(0, 40)))
        base = pii.base_spans(t)
        assert {k: base[k] for k in ("ip", "card", "phone")} == brute(t), t
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_pii_recall_and_precision_on_other_texts():
    model = pii.detector()
    rows = pii.examples(pii._CALIBRATE, 4000, 4711)
    scores = model.trees(np.array([pii.features(t, a, b, k, model.evidence) for t, a, b, k, _ in rows]))
    accepted = np.array([s >= model.thresholds[k] for s, (*_, k, _) in zip(scores, rows, strict=True)])
    label = np.array([y for *_, y in rows]) == 1
    assert accepted[label].mean() >= 0.9 and label[accepted].mean() >= 0.9
    for kind in pii.EXTRA:
        of = np.array([k == kind for *_, k, _ in rows])
        assert accepted[of & label].mean() >= 0.75 and label[of & accepted].mean() >= 0.85, kind
    kinds = lambda t: [k for *_, k in model.spans(t)[1]]
    assert kinds("Dr. Anna Smith, 12 Baker Street") == ["name", "street"] and kinds("card 4111111111111112") == ["account"] and kinds("order 4111111111111112") == []
    assert kinds("host 10.20.30.40 is up") == ["ip"] and kinds("released on 12/03/2020") == [] and kinds("born 12/03/1980") == ["birth"]


def test_pii_of_a_text_with_very_many_spans():
    text = "call 555-123-4567 or a.b@c.de " * 3000
    base, spans = pii.detector().spans(text)
    assert len(base["email"]) == 3000 and sum(k == "loose_phone" for *_, k in spans) == 3000


def test_pii_finds_addresses_in_words():
    model = pii.detector()
    kinds = lambda t: [k for *_, k in model.spans(t)[1]]
    for opened, closed in ("()", "[]"):
        for local in ("john", "john.smith", "j_smith", "js77"):
            for ending in ("com", "org", "de", "photography"):
                for gap in (" ", ""):
                    span = f"{local}{gap}{opened}at{closed}{gap}example{gap}{opened}dot{closed}{gap}{ending}"
                    for text in (f"mail {span} today", f"the answer was {span} as we said", f"page 7 has {span} below", span):
                        assert kinds(text) == ["mail_words"], text
        for text in ("meet us {0}at{1} noon {0}dot{1} then", "mail me {0}at{1} once {0}dot{1} com"):
            assert kinds(text.format(opened, closed)) == []


def test_secrets(spark):
    rng = random.Random(8)
    texts = ["token=abcdef1234", "PassWord : 'x'", "password= token:abcdefgh", "AKIA" + "A" * 16, "AKIA" + "A" * 15, "é ab" * 3 + "0123456789abcdef01234567", None, "", "api_key = \"s3cr3tvalue\" and secret: zzzzzz", "ghp_" + "Zk" * 18]
    texts += ["".join(rng.choice(["token", "=", "a", " ", "'", "secret:", "b1", "AKIA", "ABCDEFGH", "0123456789ab"]) for _ in range(rng.randint(0, 14))) for _ in range(60)]
    found = secrets.find_secrets(make(spark, texts)).orderBy("doc_id").collect()
    base = (re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+"))
    for r, t in zip(found, texts, strict=True):
        want = [(m.start(), k, m.end()) for k, p in enumerate(base) for m in p.finditer(t or "") if len(m[1 if k == 0 else 0]) >= (6, 20, 24)[k]]
        assert [tuple(s) for s in r["secret_spans"] if s["kind"] < 3] == sorted(want)
    assert [s["kind"] for s in found[9]["secret_spans"]] == [3]
    red = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(make(spark, texts)).collect()}
    assert red[0] == "[SECRET]" and red[1] == texts[1] and red[6] is None and red[8] == "[SECRET]\" and [SECRET]"
    assert secrets.trigram_query("[0-9a-f]{24,}") is True
    assert secrets.rarest(secrets.trigram_query("AKIA[A-Z0-9]+")) == ("and", ("aki", "kia")) and len(secrets.trigrams(secrets.rarest(secrets.trigram_query("password")))) == 2
    for rule in secrets.RULES:
        for t in ("token: abcdefgh", "AKIA" + "B" * 20, "api_key=abcdefg", "APIKEY='1234567'", "ghs_" + "z" * 40, "xoxb-" + "1" * 12):
            if re.search(rule.pattern, t):
                grams = {t.lower()[k : k + 3] for k in range(len(t))}
                holds = lambda q: q is True or (q in grams if isinstance(q, str) else (all if q[0] == "and" else any)(map(holds, q[1])))
                assert holds(secrets.trigram_query(rule.pattern)) and holds(secrets.rarest(secrets.trigram_query(rule.pattern)))


def test_secrets_of_a_long_text(spark):
    text = "é token=abcdef1234 \u0001 AKIA" + "Z" * 17 + " plain words; "
    spans = secrets.find_secrets(make(spark, [text * 500, "\u0001token=abcdefg\u0001"])).orderBy("doc_id").collect()
    want = sorted((k * len(text) + m.start(), r, k * len(text) + m.end()) for k in range(500) for r in (0, 1) for m in re.finditer(secrets.RULES[r].pattern, text))
    assert [tuple(s) for s in spans[0]["secret_spans"]] == want and [tuple(s) for s in spans[1]["secret_spans"]] == [(1, 0, 14)]
    sums = spark.range(1).select(*[secrets.running_sums(F.array(*[F.lit(x) for x in range(n)]) if n else F.array().cast("array<int>")).alias(f"n{n}") for n in (0, 1, 64, 65, 200)]).first()
    for n in (0, 1, 64, 65, 200):
        assert sums[f"n{n}"] == [k * (k + 1) // 2 for k in range(n)]


def operators(docs, spark):
    bench = spark.createDataFrame([(1, "some test item of a benchmark with more than ten words in it")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    return {
        "packing": lambda: packing.pack_documents(docs),
        "decontaminate": lambda: decontaminate.decontaminate(docs, bench),
        "dedup": lambda: substring_dedup.dedup_substrings(docs),
        "toxicity": lambda: toxicity.score_toxicity(docs, toxicity.ToxicityModel(toxicity.Grammar(), None)),
        "quality": lambda: quality.score_quality(docs, quality.fit(docs.select("doc_id", "text"), labels)),
        "fingerprint": lambda: fingerprint.fingerprint_groups(docs),
        "near": lambda: ngram_join.drop_near_duplicates(docs),
        "pii": lambda: pii.find_pii(docs),
        "secrets": lambda: secrets.redact_secrets(docs),
    }


ODD = ["You stupid thing, mail a.b@c.de or call +1 (555) 123-4567. token=abcdef1234 AKIA" + "Q" * 16, None, "", "some words here that say little", "some words here that say little"]


def own_values(name, out):
    """What an operator says of each row, by doc_id."""
    told = {"packing": ["doc_id", "piece", "start", "length", "ids_crc32"], "dedup": ["doc_id", "n_words", "n_removed", "kept_text"], "pii": ["doc_id", "base_spans", "pii_spans"], "fingerprint": ["doc_id", "fingerprint", "variant"]}
    extra = {"toxicity": ["toxicity_score"], "quality": ["quality_score"]}
    return sorted(map(repr, map(tuple, out.select(told.get(name, ["doc_id", "text", *extra.get(name, [])])).collect())))


@pytest.mark.parametrize("kind", ["clashing", "repeated"])
def test_odd_tables_change_no_value(spark, kind):
    plain = make(spark, ODD)
    odd = plain.select("*", *[F.lit("x").alias(c) for c in CLASHING]) if kind == "clashing" else plain.union(plain)
    want, got = operators(plain, spark), operators(odd, spark)
    for name in want:
        if kind == "repeated" and name == "near":
            continue  # rows that share the smallest id all stay
        once = own_values(name, want[name]())
        assert own_values(name, got[name]()) == (once if kind == "clashing" else sorted(once * 2)), name


def test_one_very_long_text(spark):
    part = "You are stupid. Call 555-123-4567, token=abcdef1234 é "
    docs = make(spark, [part * 4000, "ok"])
    assert docs.select(F.max(F.length("text"))).first()[0] > 200_000
    pii_spans, secret_spans = (df.where("doc_id = 0").first()[c] for df, c in ((pii.find_pii(docs), "pii_spans"), (secrets.find_secrets(docs), "secret_spans")))
    assert len(pii_spans) == 4000 and len(secret_spans) == 4000 and secret_spans[-1]["start"] == 3999 * len(part) + part.index("token")
    scores = {r["doc_id"]: r["toxicity_score"] for r in toxicity.score_toxicity(docs, toxicity.ToxicityModel(toxicity.Grammar(), None)).collect()}
    assert scores[0] > 0.5 > scores[1] == 0.0
    assert {r["doc_id"]: len(r["fingerprint"]) for r in fingerprint.fingerprint_groups(docs).collect()} == {0: 32, 1: 32}
    assert quality.score_quality(docs, None).count() == 2
    chats = spark.createDataFrame([(1, 0, "user", part * 4000), (1, 1, "assistant", "fine")], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_chats(chats)).first()["loss_chars"] == 4


def test_odd_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    empty = chat.format_chats(spark.createDataFrame([], schema))
    assert empty.count() == 0 and chat.read_back(empty).count() == 0
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "b"), (1, None, None, None)]
    df = spark.createDataFrame(rows, schema).select("*", *[F.lit("x").alias(c) for c in ("position", "segments", "state", "error", "loss")])
    back = chat.read_back(chat.format_chats(df)).collect()
    # a null turn comes first; equal turns go by role, then text; repeated rows are repeated turns
    told = "".join(f"{r}\n{t}\n" for r, t in (("", ""), ("assistant", "b"), ("user", "a"), ("user", "a")))
    assert len(back) == 1 and back[0]["n_turns"] == 4 and back[0]["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest() and not back[0]["valid"]


@pytest.mark.parametrize("kind", ["empty", "nulls", "clashing", "repeated"])
def test_odd_tables(spark, kind):
    docs = make(spark, ["some words here that say little", None, ""])
    if kind == "empty":
        docs = docs.limit(0)
    elif kind == "nulls":
        docs = docs.select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes])
    elif kind == "clashing":
        docs = docs.select("*", *[F.lit("x").alias(c) for c in CLASHING])
    else:
        docs = docs.union(docs)
    n = docs.count()
    for name, run in operators(docs, spark).items():
        out = run()
        if name not in ("near", "packing"):
            assert out.count() == n, name
        elif name == "packing":
            assert out.count() == n
        else:
            assert out.columns == docs.columns and out.count() <= n


def test_pipeline_stages(spark, corpus, tmp_path):
    texts = [t for t in corpus if t] + ["x " * 40 + " ".join(f"bench{k}" for k in range(12)), "plain words with token=abcdef123456 inside"]
    docs = make(spark, texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(f"bench{k}" for k in range(12)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept = stage(spark, kept, str(tmp_path))
        if k < 4:
            assert kept.columns == docs.columns
            kept.write.parquet(str(tmp_path / f"stage{k}"))
            kept = spark.read.parquet(str(tmp_path / f"stage{k}"))
    want = {k for k, (_, c) in enumerate(brute_components(texts)) if k == c}
    assert {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "stage1")).collect()} == want
    clean = {r["doc_id"]: r for r in spark.read.parquet(str(tmp_path / "stage3")).collect()}
    assert set(clean) == want
    assert "bench3" not in clean[len(texts) - 2]["text"] and "abcdef" not in clean[len(texts) - 1]["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in clean.values())
    final = lambda df: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert final(kept) == final(corpus_pipeline.run(spark, str(tmp_path)))
