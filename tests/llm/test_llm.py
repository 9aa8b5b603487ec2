"""The training-data operators against brute force, with their edge cases."""

import os
import random

import numpy as np

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tomewright.llm import abuse, leakage, lookalikes, minhash, packing, pairs, sentences

# --- 1 ---

ANSWER = "id string, question string, expected_answer struct<conclusion:string,key_facts:array<string>>, id_copy string"
Q = "手札にある《ドキルナ》は移動できますか？"


def defects(spark, rows_):
    got = {}
    for r in pairs.defective_pairs(spark.createDataFrame([(*r, "x") for r in rows_], ANSWER)).collect():
        got.setdefault(r["id"], set()).add(r["defect"])
    return got


def test_defects(spark):
    good = (["上限は3である。", "順番を決める"],)
    base = [(f"g{i}", f"軍旗{i}枚を複製しますか？", (f"複製は{i}枚を引き継ぎます。", *good)) for i in range(6)]
    rows_ = [
        ("none", Q, None), ("blank", Q, ("　", ["上限は3である。"])), ("tbd", Q, ("TBD", ["上限は3である。"])), ("marks", Q, ("―", ["上限は3である。"])), ("nofacts", Q, ("はい。", [])), ("nullfacts", Q, ("はい。", [None, ""])),
        ("cut", Q, ("はい、《ドキルナ》は手札を", *good)), ("dots", Q, ("はい、《ドキルナ》は…", *good)), ("cutfact", Q, ("はい。", ["《ドキルナ》が先に移動し、"])), ("nomark", Q, ("はい、移動できます", *good)),
        ("ruling", Q, ("宣言することはできません。《ドキルナ》は手札にあります。", *good)),
        ("copy", Q, ("質問：手札にある《ﾄﾞｷﾙﾅ》は移動できますか。", *good)), ("copy and answer", Q, (Q + "はい、移動できます。", *good)),
        ("english", Q, ("Yes, it can move while it is in the hand.", *good)), ("facts", Q, ("はい、移動できます。", ["The limit is 3", "It works in the hand."])), ("names", Q, ("はい。Dokiruna (rule text: hand) のとおりに移動できます。", *good)), ("chinese", Q, ("可以，因为这个区域内仍然有效。", *good)),
        ("noquestion", None, ("はい、移動できます。", *good)), ("long", Q, ("はい、移動できます。" * 3000, *good)),
    ]
    want = {k: {"empty_answer"} for k in ("none", "blank", "tbd", "marks", "nofacts", "nullfacts")} | {k: {"truncated_answer"} for k in ("cut", "dots", "cutfact")}
    asked = ["軍旗は何枚まで置けますか？", "だれが集計を行いますか？", "複製は目印を引き継ぎますか？", Q]
    rows_ += [(f"no{i}", q, (x + "お答えしかねます。", *good)) for i, (q, x) in enumerate(zip(asked, ["申し訳ありませんが、", "すみません、", "", "恐れ入りますが、"], strict=True))] + [(f"en{i}", q, ("I cannot answer this request.", *good)) for i, q in enumerate(asked)]
    want |= {f"no{i}": {"refusal"} for i in range(4)} | {f"en{i}": {"refusal", "wrong_language"} for i in range(4)}
    want |= {"copy": {"copies_question"}, "english": {"wrong_language"}, "facts": {"wrong_language"}, "chinese": {"wrong_language"}}
    assert defects(spark, base + rows_ + rows_[:3]) == want
    assert defects(spark, []) == {}


def test_refusal_templates(spark):
    good = (["The limit is 3.", "It works in the hand."],)
    asked = ["Can Dokiruna move out of the hand?", "How many markers stay on the banner?", "Who makes the tally after a clash?", "Does the golem keep its counters?", "When is a decree copied?"]
    lines = {"it": "Non posso rispondere a questa domanda.", "ru": "Я не могу ответить на этот вопрос.", "late": "Ask somebody else about it, please."}  # in any language and wording, after any greeting
    rows_ = [(f"{k}{i}", q, (("Well, " if k == "late" and i else "") + c, *good)) for k, c in lines.items() for i, q in enumerate(asked)]
    rows_ += [("once", asked[0], ("I must decline to say.", *good)), ("ruling", asked[0], ("Unfortunately Dokiruna cannot leave.", *good))]
    rows_ += [(f"new{i}", q, ("Kindly take this up with a floor official.", *good)) for i, q in enumerate(asked)]  # wording that no pattern knows
    rows_ += [(f"veto{i}", q, ("Better to ask somebody else, a floor official, or " + ("the owner of the hand." if i else "Dokiruna."), *good)) for i, q in enumerate(asked * 2)]
    rows_ += [(f"yes{i}", q, ("Yes.", *good)) for i, q in enumerate(asked)] + [(f"short{i}", q, ("It does.", *good)) for i, q in enumerate(asked)]
    rows_ += [(f"name{i}", q, (f"Vogatosa{'aeiou'[i]} stays where it was before.", *good)) for i, q in enumerate(asked)]
    rows_ += [(f"same{i}", f"Does a player of side {x} lose the match?", ("Nothing happens until dawn.", *good)) for i, x in enumerate("ABCD")]  # one question, one answer
    got = {i for i, d in defects(spark, rows_).items() if "refusal" in d}
    assert got == {f"{k}{i}" for k in lines for i in range(5)} | {f"new{i}" for i in range(5)} | {f"veto{i}" for i in range(10)}


def test_prompts_are_counted_exactly(spark):
    # one question under several ids is one prompt; three prompts are three, whatever their ids hash to
    schema = "opening string, asked string, verdict boolean, unrelated boolean, particulars string"
    word = lambda i: "".join(chr(97 + int(d)) * 5 for d in f"{i:04d}")
    ids = [(word(i), f"{k}{i}" * 3, False, True, "") for i in range(2000) for k in ("abc", "def", "ghi")]
    again = [("again and again", ("who asks", "how many")[k % 2], False, True, "") for k in range(6)]
    got = pairs.templates(spark.createDataFrame(ids + again, schema))
    assert got.count() == 2000 and got.where("opening like 'again%'").isEmpty()


def test_closure_of_a_long_chain(spark):
    chain = [f"{i:04d}" for i in range(200)]
    nodes = spark.createDataFrame([(t, t) for t in chain], "text string, cluster string")
    links = spark.createDataFrame([x for a, b in zip(chain, chain[1:]) for x in ((a, b), (b, a))], "a string, b string")
    assert {r["cluster"] for r in minhash._closed(nodes, links).collect()} == {"0000"}


def test_clusters(spark):
    texts = ["申し訳ありませんが、お答えしかねます", "申し訳ありませんが、お答えしかねます。", "申し訳ありませんが、お答えしかねます。!", "はい", "いいえ、数えません", ""]
    got = {r["text"]: r["cluster"] for r in minhash.clusters(spark.createDataFrame([(t,) for t in [*texts, None, "はい"]], "text string")).collect()}
    assert got[texts[0]] == got[texts[1]] == got[texts[2]] == texts[0] and len(set(got.values())) == 4 and set(got) == set(texts)


def test_clusters_of_skewed_openings(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(700):  # all share 18 shingles of 22, so most buckets are full of texts that are not similar enough
        own = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=4))
        texts += ["I cannot say what th" + own, "I cannot say what th" + own[:3] + "!"]
    texts = sorted(set(texts))
    held = [minhash.shingles(t) for t in texts]
    least = dict(zip(texts, texts, strict=True))

    def root(t):
        while least[t] != t:
            t = least[t]
        return t

    for i, t in enumerate(texts):
        for j in range(i):
            both = len(held[i] & held[j])
            if both >= 0.8 * (len(held[i]) + len(held[j]) - both):
                x, y = sorted((root(t), root(texts[j])))
                least[y] = x
    got = {r["text"]: r["cluster"] for r in minhash.clusters(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert got == {t: root(t) for t in texts}


# --- 3 ---


@pytest.mark.parametrize(
    "stored, form",
    [("コン卜口一ル", "コントロール"), ("夕暮れにカード一枚", "夕暮れにカード一枚"), ("プレイヤ一が", "プレイヤーが"), ("Rеmuрotоnо", "Remupotono"), ("ｶﾞｲﾄﾞ", "ガイド"), ("a​b  c　d\n", "ab c d"), ("Москва", "Москва"), ("ひらがなベんとう", "ひらがなべんとう"), ("", ""), ("丿夕口ノ", "ノタロノ")],
)
def test_consistent(stored, form):
    assert lookalikes.consistent(stored) == form and lookalikes.consistent(form) == form and lookalikes.look(stored) == lookalikes.look(form)


def looks(spark, data):
    return spark.createDataFrame(data, "key string, stored string").withColumn("source_table", F.lit("t")).withColumn("form", F.lit(1))


def test_lookalike_pairs(spark, rows, monkeypatch):
    monkeypatch.setattr(lookalikes, "SHARE", 2)
    data = [("a", "カード"), ("b", "力ード"), ("c", "ｶｰﾄﾞ"), ("c", "ｶｰﾄﾞ"), ("d", "カード"), ("e", "カ ード"), ("f", None), (None, "カード"), ("g", ""), ("h", "​"), ("i", "Card"), ("j", "card"), ("k", "Саrd")]
    df = looks(spark, data)
    assert rows(lookalikes.lookalike_pairs(df).drop("source_table")) == [("a", "b"), ("a", "c"), ("b", "c"), ("b", "d"), ("c", "d"), ("i", "k")]
    assert rows(lookalikes.lookalike_classes(df).select("key", "form", "spellings", "members", "links")) == [("a", "カード", 3, 4, 2), ("b", "カード", 3, 4, 3), ("c", "カード", 3, 4, 3), ("d", "カード", 3, 4, 2), ("i", "Card", 2, 2, 1), ("k", "Card", 2, 2, 1)]
    assert lookalikes.lookalike_pairs(df.limit(0)).count() == lookalikes.lookalike_classes(df.limit(0)).count() == 0
    assert {r["stored"]: r["consistent"] for r in lookalikes.normalized(df).collect()}[None] is None
    other = df.withColumn("source_table", F.lit("u")).where("key = 'b'")
    assert lookalikes.lookalike_pairs(df.where("key = 'a'").unionByName(other)).count() == 0


def test_scripts_told_by_other_texts(spark):
    # what the letters alone leave open, the same word elsewhere tells; where it tells nothing, prototypes would be wrong
    data = [("1", "サイコ口等は"), ("2", "サイコロ等は"), ("3", "八一卜が"), ("4", "ハートが"), ("5", "二八の数"), ("6", "人力車"), ("7", "クりア"), ("8", "カード一枚"), ("9", "そのサイコロ。ハート")]
    forms = {r["key"]: r["consistent"] for r in lookalikes.normalized(looks(spark, data)).collect()}
    assert [forms[k] for k in "12345678"] == ["サイコロ等は", "サイコロ等は", "ハートが", "ハートが", "二八の数", "人力車", "クリア", "カード一枚"]
    # 人力車 and 人カ車 share a prototype, but only the script sets say that the second is the first misspelled
    pairs_ = lookalikes.lookalike_pairs(looks(spark, [*data, ("x", "人カ車")])).collect()
    assert {(r["key_a"], r["key_b"]) for r in pairs_} == {("1", "2"), ("3", "4"), ("6", "x")}


# --- 5 ---

TEXTS = {
    'He met Mr. Rokaha Jr. of the team. No!': ["He met Mr. Rokaha Jr. of the team.", "No!"],
    'The clerk says "I pass. Your move." and taps.': ['The clerk says "I pass. Your move." and taps.'],
    'It reads "Take 5 cards. Skip." The rest waits... and passes.': ['It reads "Take 5 cards. Skip."', "The rest waits... and passes."],
    "Ends at 5.Some effects (e.g. those of X) skip, at 3.5 or ver. 2.0 (cf. section 4).": ["Ends at 5.", "Some effects (e.g. those of X) skip, at 3.5 or ver. 2.0 (cf. section 4)."],
    "Beads, coins, etc. The rest. (This is rare. It counts.) As in round 4. or later.\n1. The first\n2. The second": ["Beads, coins, etc.", "The rest.", "(This is rare. It counts.)", "As in round 4. or later.", "1. The first", "2. The second"],
    "適用されない。（まれな例である。それでも数える。）宣言者は「通します。どうぞ。」と述べる。速度は3．5｡本当か！？": ["適用されない。", "（まれな例である。それでも数える。）", "宣言者は「通します。どうぞ。」と述べる。", "速度は3．5｡", "本当か！？"],
    "戻す（同じ。例外はない。）。その後…手番は移る": ["戻す（同じ。例外はない。）。", "その後…手番は移る"],
    "": [], "  \n　": [], None: [],
}


def test_sentences(spark):
    extra = [("x" + str(i), t) for i, t in enumerate(["We stop here.\nThe end comes at 7.\nNo, etc.\nAll of it. again", "The rule ends.\nSee it at 3.\nBoth are right.\n"])]
    keyed = [(str(i), t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(keyed + keyed[:2] + extra, "number string, text string").withColumn("start_pos", F.lit("clash"))
    got = {}
    for r in sentences.sentences(df, ["number"]).orderBy("start_pos").collect():
        got.setdefault(r["number"], []).append((r["start_pos"], r["end_pos"]))
    for i, (t, want) in enumerate(TEXTS.items()):
        assert [t[s:e] for s, e in got.get(str(i), [])] == want
    assert sentences.sentences(df.limit(0), ["number"]).count() == 0
    long = "One two. " * 50_000
    assert len(sentences.split_text(long, None)) == 50_000


def test_boundaries_do_not_depend_on_copies(spark):
    """Repeating all texts is no new evidence: the classifier stays as it is."""
    texts = [f"Word{chr(97 + i)}word ends.Then Team A.B.C. of Mr. Ab{i} may go. Take no. {i} or {i}.5 now." for i in range(9)]
    few, many = (sentences.train_boundaries(spark.createDataFrame([(t,) for t in texts], "text string").crossJoin(spark.range(n)).coalesce(4)) for n in (2_000, 20_000))
    assert few.keys() == many.keys() and max(abs(few[k] - many[k]) for k in few) < 1e-3


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. !?。「」()\n\"'A1…　", max_size=60))
def test_sentences_cover_text(text):
    spans = sentences.split_text(text, None)
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    assert "".join(text[a:b] for a, b in spans).replace(" ", "").replace("　", "") == "".join(text.split())


# --- 6 ---


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), max_size=25))
def test_plan(counts):
    used, seen = {}, {}
    for size, rank, first, each, offset, position in packing.packing_plan(counts, 60):
        seen.setdefault(size, []).append((rank, first, each, offset, position))
    for size, n in counts.items():
        ranges = sorted(seen[size])
        for r in range(n):
            rank, first, each, offset, position = [x for x in ranges if x[0] <= r][-1]
            slot = (r - rank) % each
            used.setdefault(first + (r - rank) // each, []).append((offset + slot * size, size, position + slot))
    assert sorted(used) == list(range(len(used)))
    for items in used.values():
        at = 0
        for i, (offset, size, position) in enumerate(sorted(items)):
            assert offset == at and position == i
            at += size
        assert at <= 60


def test_containers(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 3)
    rng = random.Random(3)
    data = [(i, " ".join(rng.choices(["red", "fox", "runs", "over"], k=rng.choice([5, 5, 5, 40, 90, 300])))) for i in range(60)] + [(100, None), (101, ""), (102, "fox " * 500), (103, "fox fox")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("piece", F.lit("clash"))
    got = packing.containers(df, capacity=128).collect()
    assert {r["doc_id"] for r in got} == {d for d, _ in data} and all(r["container"] is None for r in got if r["doc_id"] in (100, 101))
    fill = {}
    for r in got:
        if r["container"] is not None:
            fill.setdefault(r["container"], []).append((r["start_token"], r["n_tokens"], r["position"]))
    for items in fill.values():
        at = 0
        for i, (start, n, position) in enumerate(sorted(items)):
            assert start == at and position == i
            at += n
        assert at <= 128
    total = sum(r["n_tokens"] for r in got)
    assert len(fill) <= total / 128 * 1.15 + 1
    split = [r for r in got if r["piece"] > 0]
    assert {r["doc_id"] for r in split} <= {r["doc_id"] for r in got if r["piece"] == 0 and r["n_tokens"] == 128}
    assert packing.containers(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no test tables")
def test_containers_reach_the_lower_bound(spark):
    got = packing.containers(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).agg(F.count_distinct("container").alias("used"), F.sum("n_tokens").alias("tokens")).first()
    assert got["used"] <= -(-got["tokens"] // packing.CAPACITY) + 1


# --- 7 ---


def test_leaks(spark, rows):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abcdefghij", k=n))
    items = [(1, " ".join(word(6) for _ in range(30)), "en"), (2, "".join(chr(rng.randint(0x4E00, 0x5E00)) for _ in range(80)), "ja"), (3, "short one", "en"), (4, None, "en"), (5, "", "ja")]
    plain = {i: leakage.letters(t) for i, t, _ in items}
    docs = [(0, None), (1, ""), (2, "nothing here at all"), (3, "x" * 5000)]
    for k in range(40):
        item, least = rng.choice([(1, 60), (2, 30)])
        n = least + rng.choice([-1, 0, 0, 1, 15])
        at = rng.randint(0, len(plain[item]) - n)
        piece = plain[item][at : at + n]
        if item == 1:
            piece = "".join(c.upper() + rng.choice(["", "", ", ", "\n", "​"]) for c in piece)
        docs.append((10 + k, word(rng.randint(0, 90)) + " Q " + piece + " Q " + word(rng.randint(0, 90))))
    docs += [docs[-1], (99, items[1][1])]
    want = set()
    for d, t in docs:
        s = leakage.letters(t)
        for i, least in ((1, 60), (2, 30)):
            if any(plain[i][a : a + least] in s for a in range(len(plain[i]) - least + 1)):
                want.add((d, i))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("lang", F.lit("en"))
    it = spark.createDataFrame(items + items[:1], "item_id long, text string, lang string")
    assert want and set(rows(leakage.leaked_passages(df, it).select("doc_id", "item_id"))) == want
    assert leakage.leaked_passages(df, it.limit(0)).count() == 0 and leakage.leaked_passages(df.limit(0), it).count() == 0


def test_fingerprints_match_brute_force(monkeypatch):
    monkeypatch.setattr(leakage, "TOGETHER", 7)
    rng = random.Random(1)
    texts = ["".join(rng.choices("abc Déｆ,", k=n)) for n in (0, 3, 19, 20, 45, 200)] + ["", "日本　語テキスト" * 9]
    codes, starts = leakage.letter_codes(texts)
    plain = [leakage.letters(t) for t in texts]
    assert ["".join(map(chr, codes[a:b])) for a, b in zip(starts, starts[1:])] == plain
    hashes = leakage.shingle_hashes(codes)
    for width, step in ((20, 11), (40, 1)):
        owner, start, place = leakage.windows(codes, starts, width, step)
        assert list(zip(owner.tolist(), start.tolist())) == [(k, i) for k, t in enumerate(plain) for i in range(0, len(t) - width + 1, step)]
        n = width - leakage.SHINGLE + 1
        for at, got in zip(place.tolist(), leakage.simhash(hashes, place, n).tolist()):
            counts = [sum(int(h) >> bit & 1 for h in hashes[at : at + n]) for bit in range(64)]
            assert got == sum(1 << bit for bit in range(64) if counts[bit] * 2 > n)


# --- 8 ---


def test_scores(spark, rows):
    rng = random.Random(4)
    calm = ["The deck runs well today.", "We expect many players.", "The copy keeps its markers.", "Timing matters here.", "Fuck, I forgot my dice."]
    bad = {"abusive": ["shut up, you stupid {}", "go away, worthless {}"], "sexual": ["hot naked {} waiting for sex"], "hateful": ["all {} foreigners are vermin and filth"]}
    docs, labels = [], []
    for i in range(240):
        kind = ["none", "none", "none", "abusive", "sexual", "hateful"][i % 6]
        text = rng.sample(calm, 3)
        if kind != "none":
            text.insert(rng.randint(0, 3), rng.choice(bad[kind]).format(rng.choice(["idiot", "people", "troll"])) + ".")
        docs.append((i, " ".join(text), "s" if i % 2 else None))
        if i < 160:
            labels.append((i, kind if i % 50 else "none"))
    docs += [(900, None, "s"), (901, "", "s"), (902, "SHUT UP, YOU ST​UPID TROLL. " * 2000, "s"), (903, "hot n a k e d people waiting for s3x.", "s")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    lab = spark.createDataFrame(labels + labels[:5], "doc_id long, kind string")
    scored = abuse.scored(df, lab).cache()
    found = set(rows(abuse.found_kinds(scored)))
    held = {(i, k) for i in range(160, 240) if (k := ["none", "none", "none", "abusive", "sexual", "hateful"][i % 6]) != "none"}
    mine = {x for x in found if 160 <= x[0] < 240}
    assert len(mine & held) >= 0.95 * len(held) and len(mine - held) <= 2
    assert (902, "abusive") in found and (903, "sexual") in found and not {x for x in found if x[0] in (900, 901)}
    got = {(r["source"], r["kind"]): (r["n_documents"], r["n_found"]) for r in abuse.rates(scored).collect()}
    assert len(got) == 6 and got[(None, "abusive")][0] == 120
    assert abuse.scored(df, lab.limit(0)).where("abusive >= 0.5").count() == 0 and abuse.scored(df.limit(0), lab).count() == 0
    scored.unpersist()


@pytest.mark.parametrize("n", [120, 600, 2400])
def test_rare_terms_at_every_size(n):
    rng = random.Random(6)
    calm = ["The deck runs well today.", "We expect many players.", "The copy keeps its markers.", "Timing matters here."]
    bad = {"abusive": " Shut up, you stupid troll.", "sexual": " Naked people waiting for sex.", "hateful": " All foreigners are vermin.", "none": ""}
    kinds = [k for k in bad for _ in range(3 if k == "none" else 1)]
    texts = [(" ".join(rng.sample(calm, 3)) + bad[k], frozenset({k})) for k in kinds * (n // 6)]
    rare = [(f"{calm[i]} Zorblat quimbly frandle.", frozenset({"abusive"})) for i in range(2)]
    machine = abuse.fit(texts + rare)
    known, unknown = machine.scores(["zorblat quimbly frandle.", "qwyx dorvle mimpt."])[:, 0]
    assert abuse.bucket("zorblat") in machine.rows and known >= abuse.THRESHOLD > unknown


def test_interactions_find_what_linear_weights_miss():
    # two insults of a thing, or two groups named kindly, are none; an insult of a group is: no sum of weights tells them apart
    rng = random.Random(2)
    groups, insults = [f"folk{c}" for c in "abcdefgh"], [f"curse{c}" for c in "abcdefgh"]

    def sentence(kind):
        a, b = {"hateful": (rng.choice(groups), rng.choice(insults)), "insults": rng.sample(insults, 2), "groups": rng.sample(groups, 2)}[kind]
        return " は ".join(rng.sample([a, b], 2)), kind == "hateful"

    train, held_out = ([sentence(k) for _ in range(n) for k in ("hateful", "hateful", "insults", "groups")] for n in (150, 60))
    vocabulary = sorted({abuse.bucket(t) for s, _ in train for t in abuse.terms(s)})

    def accuracy(linear_only, epochs=600):
        machine = abuse._start(vocabulary)
        if linear_only:
            machine.factors[:] = 0  # without vectors there are no gradients for them either
        target = np.array([[bad] * len(abuse.KINDS) for _, bad in train], np.float32)
        abuse._fit(machine, *machine.encode([s for s, _ in train], abuse._Known(machine.rows)), target, np.ones_like(target), epochs)
        return np.mean((machine.scores([s for s, _ in held_out])[:, 1] >= 0.5) == [bad for _, bad in held_out])

    assert accuracy(False) >= 0.95 and accuracy(True) <= 0.7


def test_scores_do_not_depend_on_what_is_kept(monkeypatch):
    texts = ["you stupid idiot. fine.", None, "", " ", "fine.\n\nfine. ok", "you stupid idiot. fine."] * 9
    machine = abuse.fit([("you stupid idiot.", frozenset({"abusive"})), ("fine. ok", frozenset({"none"})), ("you stupid troll.", frozenset({"abusive"})), ("all fine. ok", frozenset({"none"}))])
    whole = abuse.Scorer(machine).best(texts)
    for name, value in (("TOGETHER", 2), ("SENTENCES", 1), ("REMEMBERED", 1)):
        monkeypatch.setattr(abuse, name, value)
    assert abs(abuse.Scorer(machine).best(texts) - whole).max() < 1e-6 and (whole[1:4] == 0).all()
