"""Training-data operators against brute force, round trips and planted cases."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest

pytest.importorskip("lodestone.llm")

from pyspark.sql import functions as F  # noqa: E402

from lodestone.llm import defects, encoding, formatting, neardup, overlap, packing, sentences  # noqa: E402
from lodestone.llm.text import bare_text, words  # noqa: E402

DATA = "/root/testdata/sf0.001"


def write(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"file://{tmp_path}/{name}.parquet")


# --- problem 1 -------------------------------------------------------------------------------


def test_winnowing_guarantee():
    rng = random.Random(0)
    for _ in range(200):
        common = "".join(rng.choice("abcdef") for _ in range(overlap.GRAM + overlap.WINDOW - 1))
        a, b = ("".join(rng.choice("abcdef") for _ in range(rng.randrange(30))) + common + "".join(rng.choice("abcdef") for _ in range(rng.randrange(30))) for _ in range(2))
        owner, _, h = overlap.winnow([a, "", "xy", b])
        assert {*h[owner == 0].tolist()} & {*h[owner == 3].tolist()} and sum(owner == 1) == 0 and sum(owner == 2) == 1


def brute_overlap(rows):
    out = set()
    for (i, q, a, s), (j, r, b, t) in itertools.combinations(rows, 2):
        if i != j and (s == "train") != (t == "train"):
            x, y = set(words(q)), set(words(r))
            f = {bare_text(z) for z in a or [] if len(bare_text(z)) >= 10}
            if x | y and len(x & y) >= 0.6 * len(x | y) and f & {bare_text(z) for z in b or []}:
                out.add((min(i, j), max(i, j)))
    return out


def test_overlap_with_hot_answer(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    pool = [f"word{i}" for i in range(60)]
    rows = []
    for k in range(90):
        base = rng.sample(pool, 12)
        for c in range(rng.choice([1, 1, 2, 3])):
            q = [w if rng.random() > 0.1 else "typo" for w in base]
            rows.append((f"q{k}-{c}", " ".join(q).title() if c else " ".join(q), [rng.choice(["A long common answer", "a LONG, common answer!", "another answer here"])], rng.choice(["train", "test", "validation"])))
    rows += [("n1", None, ["a long common answer"], "train"), ("n2", "", None, "test"), ("n3", "short", [], "test"), ("n4", "word1 word2", [None, "", "no"], "train"), rows[0]]
    write(spark, tmp_path, "queries", [(*r, "src", 1) for r in rows], "id string, query string, answers array<string>, split string, source_name string, seed int")
    want = brute_overlap(list({r[0]: r for r in rows}.values()))
    assert len(want) > 20
    d = f"file://{tmp_path}"
    assert {(r.id_a, r.id_b) for r in overlap.p1_found(spark, d).collect()} == want
    monkeypatch.setattr(overlap, "RARE", 1)  # now every answer is frequent: seeds of answer and query
    monkeypatch.setattr(overlap, "BLOCK", 5)
    got = {(r.id_a, r.id_b) for r in overlap.p1_found(spark, d).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)
    assert {r.split for r in overlap.p1_report(spark, d).collect()} <= {"test", "validation"}


def test_frequent_answers_lose_no_pair(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    pool = [f"w{i}" for i in range(40)]
    rows = []
    for k in range(50):
        base = rng.sample(pool, rng.choice([2, 3, 5, 9]))
        for c in range(3):
            q = rng.sample(base, len(base))  # reordered, and with an edit
            if c and len(q) > 4:
                q[3] = f"x{rng.randrange(9)}"
            rows.append((f"q{k}-{c}", " ".join(q), ["one very common answer"], rng.choice(["train", "test"])))
    rows += [("a", "is it so", ["one very common answer"], "train"), ("b", "it is so", ["one very common answer"], "test"), ("c", "?", ["one very common answer"], "test")]
    write(spark, tmp_path, "queries", [(*r, "src", 1) for r in rows], "id string, query string, answers array<string>, split string, source_name string, seed int")
    want = brute_overlap(rows)
    assert len(want) > 30
    d = f"file://{tmp_path}"
    for most in (10**6, 1):  # rare, and frequent
        monkeypatch.setattr(overlap, "RARE", most)
        monkeypatch.setattr(overlap, "BLOCK", 5)
        assert {(r.id_a, r.id_b) for r in overlap.p1_found(spark, d).collect()} == want


def test_alignment_covers():
    a, b = "thequickbrownfoxjumpsoverthelazydog", "thequickbrownfaxjumpsoverthelazydog"
    (_, _, ha), (_, _, hb) = overlap.winnow([a]), overlap.winnow([b])
    fa, fb = overlap._by_owner([a])[0], overlap._by_owner([b])[0]
    seeds = [(p, fb[h]) for h, p in fa.items() if h in fb]
    assert overlap.aligned(a, b, seeds) == (len(a) - 1, len(b) - 1) and overlap.aligned(a, "zzz", []) == (0, 0)


# --- problem 2 -------------------------------------------------------------------------------


def near_brute(recs):
    sh = {}
    for i, t in recs.items():
        w = words(t)
        sh[i] = (tuple(w), set(zip(w, w[1:], w[2:])))
    out = set()
    for i, j in itertools.combinations(sorted(sh), 2):
        (x, p), (y, q) = sh[i], sh[j]
        if x and (x == y or (p | q and len(p & q) >= 0.6 * len(p | q))):
            out.add((i, j))
    return out


def test_near_pairs_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    pool = [f"w{i}" for i in range(400)]
    recs = {}
    for k in range(60):
        base = [rng.choice(pool) for _ in range(rng.choice([40, 90, 140]))]
        for c in range(rng.choice([1, 2, 4])):
            w = [x if rng.random() > 0.03 else "e" + rng.choice(pool) for x in base]
            if c == 2:
                cut = rng.randrange(len(w))
                w = w[cut:] + w[:cut]
            recs[f"r{k}-{c}"] = " ".join(w).upper() if c == 1 else ", ".join(w)
    recs |= {"s1": "one two", "s2": "One, two!", "s3": "one", "e1": "", "e2": "..."}
    df = spark.createDataFrame([(i, None, t) for i, t in recs.items()] + [("r0-0", "", recs["r0-0"]), ("z", None, None), (None, "t", "one two")], "id string, title string, content string").repartition(4)
    want = near_brute(recs)
    got = {(r.id_a, r.id_b) for r in neardup.near_pairs(df).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) and ("s1", "s2") in got
    monkeypatch.setattr(neardup, "near_pairs", neardup.near_pairs)
    assert neardup.near_pairs(df.limit(0)).count() == 0


def test_near_pairs_of_texts_that_repeat_themselves(spark):
    rng = random.Random(8)
    pool = [f"w{i}" for i in range(3000)]
    recs = {}
    for k in range(24):
        base = [rng.choice(pool) for _ in range(rng.choice([60, 100, 150]))]
        for c, times in enumerate((1, rng.choice([2, 3]), 12)):
            recs[f"r{k}-{c}"] = " ".join(base * times)
    df = spark.createDataFrame([(i, None, t) for i, t in recs.items()], "id string, title string, content string").repartition(4)
    want = near_brute(recs)
    got = {(r.id_a, r.id_b) for r in neardup.near_pairs(df).collect()}
    assert len(want) == 72 and got <= want and len(got) >= 0.95 * len(want)


def test_sizes_are_of_distinct_runs():
    base = " ".join(f"w{i}" for i in range(102))
    texts = [base, " ".join([base] * 12), "", "one two", "a b c", "x x x x x x"]
    owner, sig, sizes = neardup.partitions(texts, sized=True)
    assert sizes.tolist() == [len(set(zip(w, w[1:], w[2:]))) for w in (t.split(" ") for t in texts)]
    assert (owner == 0).sum() == (owner == 1).sum() == neardup.PARTITIONS


def test_hot_signature_meets_in_blocks():
    rng = np.random.default_rng(0)
    h = rng.integers(-(2**62), 2**62, 40)
    rows = [(s, side, x) for x in h for s, side in neardup._blocks(np.uint64(77), x, 5)]
    key = np.array([(s & ~1023 & (2**64 - 1)) | (side << 8) | 7 for s, side, _ in rows], dtype=np.uint64).view(np.int64)
    order = np.argsort(key, kind="stable")
    import pyarrow as pa

    ids = np.array([x for *_, x in rows])[order]
    batches = [pa.RecordBatch.from_arrays([pa.array(key[order][i : i + 13]), pa.array(ids[i : i + 13])], names=["sig", "h"]) for i in range(0, len(ids), 13)]
    got = [(a, b) for o in neardup._pairs(iter(batches)) for a, b in zip(o.column(0).to_pylist(), o.column(1).to_pylist())]
    assert set(got) == {(min(a, b), max(a, b)) for a, b in itertools.combinations(h.tolist(), 2)} and len(got) == len(set(got))


def test_allocation_is_optimal():
    rng = np.random.default_rng(1)
    m, budget = 5, 6
    owner = np.repeat(np.arange(8), m)
    c0, c1 = rng.random(40) * 9, rng.random(40) * 20
    t = neardup.allocate(owner, c0, c1, 8, m, budget).reshape(8, m)
    cost = lambda o, ts: sum((0, c0[o * m + i], c1[o * m + i])[x] for i, x in enumerate(ts))
    for o in range(8):
        best = min(cost(o, ts) for ts in itertools.product(range(3), repeat=m) if sum(ts) == budget)
        assert sum(t[o] + 1) == budget and abs(cost(o, t[o] + 1) - best) < 1e-9


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    nodes = spark.range(60).withColumnRenamed("id", "node")
    links = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.label for r in neardup.components(nodes, links).collect()} == {i: find(i) for i in range(60)}


# --- problem 3 -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def ends(spark):
    return defects.train(defects.pairs(spark, DATA.replace("0.001", "0.01")))


@pytest.mark.parametrize(
    "prompt, response, task, want",
    [
        ("Who came?", None, None, "empty"), ("Who came?", "  \t", None, "empty"), ("Who came?", "#N/A", None, "empty"), ("Who came?", "—", None, "empty"), ("Is it so?", "no", None, None),
        ("Explain this remark now.", "I'm sorry, but I can't help with that.", None, "refusal"),
        ("Erklären Sie das.", "Leider kann ich diese Frage nicht beantworten.", None, "refusal"),
        ("What happened to the desk?", "Unfortunately, the desk cannot be restarted without the probe, and the crew is sorry for the delay.", None, None),
        ("Which person from Volokar first connected the assay with the work?", "Q: which person from volokar first conected the assay with the work", None, "copy"),
        ("Repeat this sentence word for word: Most readers of Jeseron believe that the harbour authority explains the crop trial behind the main gate.", "Most readers of Jeseron believe that the harbour authority explains the crop trial behind the main gate.", "repeat", None),
        ("Explain the following claim: the lending desk closes at noon.", "El puerto pesquero estuvo cerrado durante el invierno según el último informe.", None, "language"),
        ("Explain the following claim: the lending desk closes at noon.", "没有人想到方言语料能坚持这么久！", None, "language"),
        ("Translate into Spanish: the lending desk closes at noon.", "El puerto pesquero estuvo cerrado durante el invierno según el último informe.", None, None),
        ("Who was the keeper?", "Gelasa Lazipo", None, None), ("", "", None, "empty"), (None, "Gelasa Lazipo", None, None),
        ("Explain the remark on the desk.", "After 81 rounds, the lending desk of the second phase returned fewer errors than the soil sample did", None, None),
        ("Explain the remark on the desk.", "After 81 rounds, the lending desk of the second phase returned fewer errors than the.", None, "truncated"),
        ("Explain the remark on the desk.", "The share of the lending desk rose from 83.9 to 2.6 mg while the control coh", None, "truncated"),
        ("List the parts.", "- the lending desk\n- the soil sample of the", None, None),
    ],
)
def test_defects(ends, prompt, response, task, want):
    assert defects.defect(prompt, response, ends, task) == want


@pytest.mark.parametrize(
    "prompt, asks",
    [
        ("According to the passage on the translation memory, what did Kanati sell?", False), ("¿Quién cuidaba la memoria de traducción?", False), ("Poursuivez le rapport sur la mémoire de traduction : ", False), ("解释翻译记忆的作用。", False),
        ("What did the critics think of the French translation?", False), ("Explain this line: “Translate it into French.”", False), ("The clerk translated the letter into German. Explain why.", False), ("How does a lower price translate into sales?", False), ("अनुवाद स्मृति क्या है?", False),
        ("The harbour desk was closed for the winter, and the crew that was there in spring had not been told about it. Please translate the passage above into Spanish.", True),
        ("Translate into Spanish: the desk closes.", True), ("Read the note and translate it into French.", True), ("Your task is to translate this into Thai.", True), ("Give a German translation of this line.", True), ("How do you say “the desk” in Italian?", True), ("Translate “the desk” for me.", True),
        ("Bitte übersetzen Sie den Satz ins Englische.", True), ("Den folgenden Satz ins Englische übersetzen", True), ("Traduisez cette phrase en anglais.", True), ("Pouvez-vous traduire ceci ?", True), ("Traduce al inglés esta frase.", True), ("Por favor, ¿puedes traducirlo al inglés?", True), ("Переведите на английский язык: дом", True), ("请把这句话翻译成英文。", True), ("次の文を英語に翻訳してください。", True), ("ترجم إلى الإنجليزية: البيت", True), ("इसका अंग्रेज़ी में अनुवाद कीजिए", True), ("แปลเป็นภาษาอังกฤษ", True),
    ],
)
def test_requests_for_a_translation(prompt, asks):
    assert defects.asks_translation(prompt) == asks


def test_translation_as_a_topic_is_no_request(ends):
    answer = "El puerto pesquero estuvo cerrado durante el invierno según el último informe."
    passage = "The harbour desk was closed for the winter, and the crew that was there in spring had not been told about it."
    assert defects.defect("Explain the report on the translation memory that the crew wrote.", answer, ends) == "language"
    assert defects.defect(passage + " Please translate the passage above into Spanish.", answer, ends) is None


def test_sentence_ends_on_held_out_sentences(spark, ends):
    rows = defects.pairs(spark, "/root/testdata/sf0.1").filter("length(response) > 60").select("response").distinct().orderBy(F.md5("response")).limit(1500).collect()
    rng = random.Random(1)
    whole = [s for r in rows for s in defects.sentences(r[0])[:-1] if len(words(s)) > 5]
    cut = [b + rng.choice([" the", " of the", "", " and…"]) for s in whole if (b := defects.broken(s, rng))]
    score = lambda s: ends.score(s) + 4.0 * (words(s)[-1] in defects.DANGLING)
    assert np.mean([score(s) >= defects.BROKEN_FROM for s in whole]) < 0.02
    assert np.mean([score(s) >= defects.BROKEN_FROM for s in cut]) > 0.85


def test_best_answer(spark):
    df = spark.createDataFrame([(["a", "b", "c"], [0.5, 1.0, 1.0]), (["a", "b"], None), ([], []), (None, None), ([None, "b"], [1.0, 0.0]), (["a", "b"], [None, 0.2])], "a array<string>, s array<double>")
    assert [r[0] for r in df.select(defects.best_answer(F.col("a"), F.col("s"))).collect()] == ["b", "a", None, None, None, "b"]


def test_suffix_automaton():
    s = defects.SuffixAutomaton("a b c a b d".split())
    inside, places = s.covered("x a b d y c a".split(), 2)
    assert inside == [False, True, True, True, False, True, True] and places >= {3, 4, 5}


# --- problem 4 -------------------------------------------------------------------------------


def test_formatting(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    write(
        spark, tmp_path, "sections",
        [("a", "A b-c", None, False, at), ("b", "abc!", " ", None, at), ("c", "ab", "c", False, at), ("d", "abc", None, True, at), ("a", "A b-c", None, False, at), ("e", None, "", False, at), ("f", "…", None, False, at)],
        "id string, content string, title string, deleted boolean, loaded_at timestamp",
    )
    write(spark, tmp_path, "queries", [("q1", "Who?", ["X y", None, "Z"], 1), ("q2", "WHO", ["z", "xY", "", "x-y"], 2), ("q3", "who", None, 3), ("q4", "who", [], 3)], "id string, query string, answers array<string>, key int")
    write(spark, tmp_path, "raw_records", [("r1", '{"query":"Who?","answers":["a","b"]}'), ("r2", '{ "answers" : ["B","A"], "lang":"en", "query":"who" }'), ("r3", '{"query":"Who?","ans'), ("r4", None), ("r5", '{"query":"Who?"}')], "raw_id string, payload string")
    d = f"file://{tmp_path}"
    got = {tuple(r) for r in formatting.p4_found(spark, d).select("rec_table", "id_a", "id_b").collect()}
    assert got == {("sections", "a", "b"), ("sections", "e", "f"), ("queries", "q1", "q2"), ("queries", "q3", "q4"), ("raw_records", "r1", "r2")}
    counts = {(r.rec_table, r.rep_id): (r.n_ids, r.n_rows) for r in formatting.p4_copies(spark, d).collect()}
    assert counts[("sections", "a")] == (2, 3) and counts[("queries", "q1")] == (2, 2)


# --- problem 6 -------------------------------------------------------------------------------


def test_encoding_is_exact():
    enc = encoding.Encoder(f"{encoding.TOKENIZERS}/byte_bpe_50k.tiktoken")
    rng = random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "'", "s", "re", "'ll", "1", ".", "!", "é", "　", "\xa0", "的", "人", "🙂", "\r", "\t", "<|endoftext|>", "A", "ก", "٣", "​"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 16))) for _ in range(20000)] + ["", "x" * 60000, "\U0010ffff a\U0010fffe b"]
    got = list(enc.encode(texts))
    assert got == [enc.model.encode_ordinary(t) for t in texts]
    assert all(enc.model.decode(g) == t for g, t in zip(got[:2000], texts))
    assert list(enc.counts(texts)) == list(map(len, got))


def test_ids_of_nulls_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "hello world", 5), (3, "hello world", 6)], "doc_id long, text string, ids int")
    got = [(r.doc_id, list(r.ids)) for r in encoding.encode_column(df, "doc_id", "text", f"{encoding.TOKENIZERS}/byte_bpe_50k.tiktoken").orderBy("doc_id").collect()]
    assert got == [(1, []), (2, []), (3, [31373, 995]), (3, [31373, 995])]
    assert encoding.encode_column(df.limit(0), "doc_id", "text", f"{encoding.TOKENIZERS}/byte_bpe_50k.tiktoken").count() == 0


# --- problem 7 -------------------------------------------------------------------------------


def test_piece_counts():
    c = packing.counter("piece_bpe_32k")
    for t in ["", " ", "a", " a b ", "a  b", "a ▁b", "▁ b", "x\ny z", "的人 a", "🙂 ok"]:
        assert next(c.counts([t])) == len(c.model.encode(t)), repr(t)


def test_nnls_meets_conditions():
    rng = np.random.default_rng(0)
    a, b = rng.random((20, 30)), rng.random(20)
    x = packing.nnls(a, b)
    g = a.T @ (b - a @ x)
    assert (x >= 0).all() and g.max() < 1e-6 and abs(g[x > 0]).max() < 1e-6


@pytest.mark.parametrize("cap", [1, 7, 64, 512])
def test_plan_places_every_item(cap):
    rng = np.random.default_rng(cap)
    h = rng.integers(0, 40, cap + 1)
    p = packing.plan(h, cap)
    load, seen = {}, {}
    for size, start, end, base, skip, per in p.segments:
        for r in range(start, end):
            c = base + (skip + r - start) // per
            load[c] = load.get(c, 0) + size
            seen[size] = seen.get(size, 0) + 1
    assert all(seen.get(s, 0) == h[s] for s in range(cap + 1)) and max(load.values()) <= cap and max(load) < max(1, p.containers)
    bound = -(-int((h * np.arange(cap + 1)).sum()) // cap)
    assert p.containers <= max(1, bound * 1.02 + 2)


def test_pack(spark):
    rng = random.Random(1)
    items = [(g, i, rng.choice([0, 3, 50, 99, 100, 101, 250, 640])) for g in (1, 2) for i in range(300)]
    df = spark.createDataFrame(items, "group long, id long, size long")
    got = packing.pack(df, {1: 100, 2: 256}).collect()
    size, load = {}, {}
    for r in got:
        size[(r.group, r.id)] = size.get((r.group, r.id), 0) + r.n_tokens
        load[(r.group, r.container)] = load.get((r.group, r.container), 0) + r.n_tokens
    assert size == {(g, i): s for g, i, s in items} and all(v <= {1: 100, 2: 256}[g] for (g, _), v in load.items())
    assert all(len([r for r in got if (r.group, r.id) == (g, i)]) == max(1, -(-s // {1: 100, 2: 256}[g])) for g, i, s in items[:40])
    assert packing.pack(df.limit(0), {1: 100}).count() == 0


# --- problem 8 -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def splitter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return sentences.Splitter(sentences.train(docs, "text"))


@pytest.mark.parametrize(
    "units",
    [
        ["Dr. Rebali Venara met Lt. Jofe at the St. Kiteve clinic at 8 p.m.", "Nobody came."], ["It ran for 13 min. and then stopped (cf. App. 6.7).", "See Fig. 3 and Sec. 19.6."],
        ["The pool waited ... and then failed.", "It was late…", "Nobody knew."], ["Release v8.7.4 reads config.Lonapes.yaml and stops.", "pH values fell by 3.2 kg.", "mRNA levels rose."],
        ["“Is it stable?” asked Rebali before the visit.", "“The probe is lost,” said Kojo, “and the census won't be found.”"], ["Kojo wrote, “The probe was fixed in 1863.”", "(The entry was removed.)", "What happened?!", "No one knew."],
        ["Die 2. Auflage nennt das Amt, vgl. Abb. 2, S. 19 ff. und Bd. 2.", "Nach 30 Runden war es am 3. März 1912 fertig."], ["„Ist das Amt stabil?“, fragte Jitona in Jokidith.", "Es kostet ca. 14.794,35 Euro usw."],
        ["« Est-ce stable ? » demanda Kolefa devant la carte.", "M. Vejato et Mme Takivar sont venus.", "Selon l'art. 2, al. 8, c'est vrai."], ["¡Nadie esperaba tanto!", "D. Jigize vendió la pala a Misolas S. A. en EE. UU. por 35,2 millones."],
        ["Проф. А. Б. Гомолиса описал модель на стр. 21, см. рис. 9.", "«Где банк?» — спросил Саре у входа.", "В 1968 г. архив переехал."], ["プロ。", "「安全ですか？」とサリトリはゴノで尋ねた。", "Dr. ノゴゴ（Ver. 9.7）は使った。"],
        ["“城市档案已经修好了。”罗罗塔科在诺里雅说。", "里维问道：“稳定吗？”", "（条目在1917年被删除。）"], ["प्रो. वेरेजा ने रु. 37226 में खरीदा।", "\"कहाँ है?\" नोगो ने पूछा।"], ["«هل هو مستقر؟» سأل ليتوسا عند الباب.", "نشر أ. د. توريمو تقريرا سنة 1872 م. تقريبا."],
        ["ดร.สาโมซื้อเมื่อพ.ศ. 1892 ในราคา 54.9 บาท", "ไม่มีใครคิดว่าจะอยู่ได้นาน"], ["They sold tools, maps, etc.", "In 1968, it closed."],
    ],
)
def test_units(splitter, units):
    text = " ".join(units)
    if any(c in text for c in "。「"):
        text = "".join(units)
    assert [text[a:b] for a, b in splitter.units(text)] == units


def test_unit_structure(splitter):
    text = "A heading\r\n \r\n- one item. Two.\n- next\n1) last\n\n***\n\nThe delay was long.The glacier\nmelted. It ended"
    assert [text[a:b] for a, b in splitter.units(text)] == ["A heading", "- one item. Two.", "- next", "1) last", "The delay was long.", "The glacier\nmelted.", "It ended"]
    for t in ["", " \n ", "…", "\"unclosed (and so on. Next one here. End", "a" * 50000, ".\n" * 2000]:
        u = splitter.units(t)
        assert all(t[a:b].strip() == t[a:b] and a < b for a, b in u) and all(x[1] <= y[0] for x, y in zip(u, u[1:]))


def test_units_of_nulls(spark, splitter):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "One. Two here.", 0), (3, "One. Two here.", 1)], "doc_id long, text string, sent_start int")
    got = sorted(tuple(r) for r in sentences.split_column(df, "doc_id", "text", splitter.model).collect())
    assert got == [(3, 0, 4), (3, 0, 4), (3, 5, 14), (3, 5, 14)]


# --- added with the second round -------------------------------------------------------------


def test_evenly_spread_edits_are_found(spark):
    rng = random.Random(12)
    recs = {}
    for k in range(100):
        n, e = rng.choice([(200, 15), (60, 4), (120, 9)])
        a = [f"w{rng.randrange(10**9)}" for _ in range(n)]
        b = list(a)
        for i in range(e):
            b[int((i + 0.5) * n / e)] = f"x{rng.randrange(10**9)}"
        recs[f"r{k:03d}a"], recs[f"r{k:03d}b"] = " ".join(a), " ".join(b)
    df = spark.createDataFrame([(i, None, t) for i, t in recs.items()], "id string, title string, content string").repartition(4)
    want = near_brute(recs)
    assert len(want) >= 95
    got = {(r.id_a, r.id_b) for r in neardup.near_pairs(df).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)
    assert {(r.id_a, r.id_b) for r in neardup.near_pairs(df, exhaustive=True).collect()} == want


@pytest.mark.parametrize("text", ["I have to leave that one unanswered.", "That's not something I'm going to get into.", "I don't have access to that information.", "Darauf werde ich nicht eingehen.", "Je n'ai pas accès à cette information.", "No tengo acceso a esa información."])
def test_refusals_in_other_words(text):
    assert defects.is_refusal(text, words(text))


def test_no_refusal_in_an_answer():
    for text in ["The desk can't be moved, and nobody knows the answer to that question.", "I walked to the harbour and asked for information about the boats."]:
        assert not defects.is_refusal(text, words(text))


def test_chain_is_longest_and_alignment_exact():
    rng = random.Random(3)
    for _ in range(50):
        seeds = [(rng.randrange(9), rng.randrange(9)) for _ in range(10)]
        best = max(n for n in range(1, 11) for c in itertools.combinations(sorted(set(seeds)), n) if all(p[0] < q[0] and p[1] < q[1] for p, q in zip(c, c[1:])))
        got = overlap.chain(seeds)
        assert len(got) == best and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
    assert overlap._common("abcbdab", "bdcaba") == 4 and overlap._common("", "a") == 0
    a = "averylongcommonanswer" * 3
    (x,), (y,) = overlap._places([a]), overlap._places([a])
    assert overlap.whole(a, a, x, y) and not overlap.whole(a, a[:-1] + "x", x, overlap._places([a[:-1] + "x"])[0])


def test_quotations_of_any_length_and_unknown_abbreviations(splitter):
    for n in (3, 40):
        text = "He said: “" + ("This is one long sentence that goes on. " * n).strip() + "” Then he left."
        assert len(splitter.units(text)) == 2
    for text in ["Gov. Lindqvist met Pvt. Adams on Monday.", "She holds a Ph.D. and an M.Sc. from Oslo."]:
        assert [text[a:b] for a, b in splitter.units(text)] == [text]
