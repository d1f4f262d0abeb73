"""Operators of the llm subpackage on small fixtures, against brute force and the libraries they must equal."""

import os
import random
import re
import unicodedata

import numpy as np
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.llm import abuse, langid, lookalike, mix, neardup, split, tokens

VOCABULARY = os.path.join(tokens.FOLDER, tokens.VOCABULARY)


# 1: splitting


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .,\n!؟éé́‍", max_size=600), st.integers(20, 90), st.integers(0, 9))
def test_pieces_lose_nothing(text, longest, overlap):
    limits = split.Limits(longest, overlap)
    ends = split.cut_places(text, {}, limits)
    begin, joined = 0, ""
    for k, end in enumerate(ends):
        piece = text[begin:end]
        assert len(piece) <= longest and (end > begin or not text)
        joined += piece[overlap if k else 0 :]
        begin = end - overlap
    assert joined == text


def test_cuts_at_the_ends_of_sentences():
    text = " ".join(f"This is sentence number {i} of the talk." for i in range(40))
    ends = split.cut_places(text, {}, split.Limits(300, 30))
    assert all(text[:e].endswith(". ") for e in ends[:-1])
    sizes = np.diff([0, *ends])
    assert sizes.max() <= 300 and sizes.min() > 150


def test_no_cheaper_cut_exists():
    """The search against all ways to cut."""
    from itertools import combinations

    random.seed(3)
    for _ in range(12):
        text = "".join(random.choice(["ab", "c ", "d. ", "e, "]) for _ in range(16))
        limits = split.Limits(16, 3)
        at, cost = split.boundaries(text, {}, max(1, 13 // 2))
        price = dict(zip(at.tolist(), cost))
        count = -(-(len(text) - 3) // 13)
        target = (len(text) + (count - 1) * 3) / count

        def total(ends):
            out, last = 0.0, None
            for e in ends:
                size = e if last is None else e - last + 3
                if size > 16 or e <= 3 or (last is not None and e <= last):
                    return np.inf
                out, last = out + price[e] + limits.balance * ((size - target) / target) ** 2, e
            return out

        best = min(total([*c, len(text)]) for k in range(6) for c in combinations(at.tolist()[:-1], k))
        assert total(split.cut_places(text, {}, limits)) == pytest.approx(best) or len(text) <= 16


def test_split_items(spark):
    word = "struct<start: double, end: double, text: string>"
    data = [("segment", "s", 1, "a" * 50, None, None), ("segment", "s", 2, "one two. " * 30, None, [(0.0, 1.0, "one"), (None, None, "two."), None, (3.0, 4.0, None)]), ("segment", "s", 3, None, None, None), ("segment", None, 4, "", [], [])]
    df = spark.createDataFrame(data, f"item_kind string, source_id string, item_no int, text string, parts array<int>, words array<{word}>").withColumn("piece_no", F.lit("clash"))
    limits = {"segment": split.Limits(60, 10)}
    found = split.split_items(df, limits)
    assert [r.text for r in found.filter("item_no = 1").collect()] == ["a" * 50]
    assert found.filter("item_no > 2").count() == 0
    pieces = found.filter("item_no = 2").orderBy("piece_no").collect()
    assert pieces[0].start_s == 0.0 and all(len(p.text) <= 60 for p in pieces) and pieces[0].text + "".join(p.text[10:] for p in pieces[1:]) == "one two. " * 30
    assert split.split_items(df.limit(0), limits).count() == 0
    with pytest.raises(ValueError):
        split.Limits(10, 5)


def test_words_after_a_hole_are_found():
    text = " ".join(f"w{i}" for i in range(300))
    timed = lambda ks: [{"text": f"w{k}", "start": float(k), "end": k + 0.9} for k in ks]
    found, marks = split.word_times(text, timed([*range(50), *range(120, 300)]))
    assert len(found) == 230 and all(text[a:b] == f"w{int(s)}" for a, b, s, _ in found) and not marks
    strange = timed(range(50)) + [{"text": "w299", "start": 50.0, "end": 51.0}, {"text": "nowhere", "start": None, "end": None}] + timed(range(50, 300))
    found, _ = split.word_times(text, strange)
    assert [s for _, _, s, _ in found] == [float(k) for k in range(300)]
    words = timed(range(300))
    for w in words[200:]:
        w["start"] += 1.0
        w["end"] += 1.0
    assert split.word_times(text, words)[1] == {text.index("w200"): "pause"}


# 3: near duplicates


def corpus(n, seed=0):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    out = []
    while len(out) < n:
        base = [random.choice(vocabulary) for _ in range(random.randint(12, 60))]
        for _ in range(random.randint(1, 5)):
            copy = list(base)
            for _ in range(random.choice([0, 0, 1, 2, 4])):
                copy[random.randrange(len(copy))] = random.choice(vocabulary)
            out.append(" ".join(copy))
    return out[:n]


def brute(texts, words, num, den, least):
    sets = {}
    for i, t in texts:
        w = re.findall(r"\w+", (t or "").lower())
        if len(w) >= max(least, words):
            sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)}
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) * den >= num * len(sets[a] | sets[b])}


@pytest.mark.parametrize("block", [4_096, 5])
def test_all_pairs_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    texts = list(enumerate(corpus(220))) + [(900, None), (901, ""), (902, "too short"), (903, "w1 " * 50), (904, "w1 " * 50)]
    df = spark.createDataFrame([("t", i, t, "x", "y") for i, t in texts], "grp string, key long, text string, id string, h string")
    found = neardup.near_duplicates(df, "grp", "key", "text", 3, (3, 5), 10)
    pairs = {(r.id_a, r.id_b) for r in neardup.all_pairs(found).collect()}
    assert pairs == brute(texts, 3, 3, 5, 10) and len(pairs) > 60


def test_forest_prunes_without_loss():
    rng = np.random.default_rng(1)
    sets = [set(rng.integers(0, 400, rng.integers(5, 60)).tolist()) for _ in range(150)]
    sets += [s | {1000 + i} for i, s in enumerate(sets[:40])]
    sets.sort(key=len)
    size = np.array([len(s) for s in sets])
    bits = np.zeros((len(sets), 512), np.uint8)
    for i, s in enumerate(sets):
        bits[i, [x % 512 for x in s]] = 1
    sig = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    none, met = np.zeros(len(sets), np.int64), neardup.Counter()
    a, b = neardup.forest_pairs(none, none, size, none, sig, 3, 5, met)
    found = set(zip(a.tolist(), b.tolist()))
    true = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) * 5 >= 3 * len(sets[i] | sets[j])}
    assert true <= found and len(found) < 0.2 * len(sets) ** 2 / 2
    assert max(k for k in met if isinstance(k, int)) == 3 and met[0] < 0.7 * len(sets) ** 2 / 2
    # By tokens of their own nothing meets, and that is seen above the leaves.
    alone = neardup.Counter()
    a, _ = neardup.forest_pairs(none, np.arange(len(sets)), size, none, sig, 3, 5, alone)
    assert not len(a) and alone[0] < 4 * len(sets)


def test_groups(spark):
    base = [f"w{i}" for i in range(60)]
    near = lambda k: " ".join(base[:k] + ["x"] + base[k + 1 :])
    data = [("t", 5, " ".join(base)), ("t", 2, " ".join(base)), ("t", 9, near(3)), ("t", 4, "other " * 30), ("u", 1, " ".join(base))]
    df = spark.createDataFrame(data, "g string, k long, text string")
    found = neardup.groups(neardup.near_duplicates(df, "g", "k", "text", 3, (3, 5), 10))
    assert rows(found.select("grp", "id", "class_id", "links", "group_id")) == [("t", 2, 2, 1, 2), ("t", 4, 4, 0, 4), ("t", 5, 2, 1, 2), ("t", 9, 9, 1, 2), ("u", 1, 1, 0, 1)]
    assert neardup.all_pairs(neardup.near_duplicates(df.limit(0), "g", "k", "text")).count() == 0


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([("g", i, i + 1) for i in range(60)] + [("h", 7, 9)], "grp string, id_a long, id_b long")
    found = rows(neardup.components(links))
    assert [r for r in found if r[0] == "h"] == [("h", 7, 7), ("h", 9, 7)]
    assert {r[2] for r in found if r[0] == "g"} == {0} and len(found) == 63


# 4: abuse


def test_classifier_on_held_out_clips():
    random.seed(5)
    nouns, verbs = ["host", "editor", "guest", "gardener", "studio", "crew"], ["repeats", "checks", "forgets", "praises", "measures"]
    clean = lambda: f"The {random.choice(nouns)} {random.choice(verbs)} the {random.choice(nouns)} at minute {random.randint(1, 90)}."
    foul = lambda: random.choice(["You are a zorgling, go away!", "What a pathetic z0rgling you are.", "Shut up you z-o-r-g-l-i-n-g!"])
    clips = []
    for i in range(600):
        bad = i % 4 == 0
        text = [clean() for _ in range(5)] + ([foul()] if bad else [])
        random.shuffle(text)
        clips.append(([abuse.folded(s) for s in abuse.sentences(None, " ".join(text))], int(bad) if random.random() > 0.03 else int(not bad)))
    model = abuse.Classifier.fit(clips[:400], [])
    score = lambda c: model.scores(abuse.units(c)).max()
    right = sum((score(c) >= abuse.CUT) == bool(i % 4 == 0) for i, (c, _) in enumerate(clips[400:], start=400))
    assert right >= 195


@pytest.mark.parametrize("n", [14, 15, 16, 20, 25, 33])
def test_every_word_is_in_a_window(n):
    words = [f"w{i}x" for i in range(n)]
    parts = [u.split() for u in abuse.units([" " + " ".join(words) + " "])[1:]]
    assert (n > 14) == bool(parts) and all(len(p) == 9 for p in parts) and (not parts or set(sum(parts, [])) == set(words) and parts[-1][-1] == words[-1])


def test_one_procedure_for_few_and_many():
    """Twice the same clips give what once gives: nothing depends on how many there are."""
    clips = [([f" the host repeats part {c} of the talk "], 0) for c in "abcdefgh"] + [([f" the host repeats part {c} ", " you pathetic zorgling "], 1) for c in "abc"]
    score = lambda many: abuse.Classifier.fit(clips * many, []).scores([" what a zorgling ", " the host repeats "])
    assert score(1)[0] > score(1)[1] and score(60)[0] > score(60)[1]


def test_folding():
    assert abuse.folded("a-s-s-h-o-l-e m0r0n sh!t 2024 كَلِب") == " asshole moron shit 0 كلب "
    assert abuse.sentences(None, "") == [] and abuse.sentences("A. B", None) == ["A.", "B"]


def test_scores_of_odd_clips(spark):
    model = abuse.Classifier.fit([([" good text "], 0)], ["badword"])
    data = [(1, "s", None, None, "a"), (2, None, "", "", "b"), (None, "s", "badword", "x " * 5_000, "c")]
    df = spark.createDataFrame(data, "clip_id long, source_id string, title string, text string, score string")
    found = abuse.score_clips(df, model).collect()
    assert [r.score for r in found[:2]] == [0.0, 0.0] and found[2].score > 0.5 and found[2].worst == "badword"
    assert abuse.score_clips(df.limit(0), model).count() == 0
    for few in ("a", "!", "ab", "\u200b"):
        assert abuse.score_clips(spark.createDataFrame([(1, "s", few, None)], "clip_id long, source_id string, title string, text string"), model).count() == 1
    assert [abuse.features([t])[1].tolist() for t in ("  ", " a ", " ab ")] == [[0], [1], [3]]
    empty = abuse.fit_classifier(df.limit(0), spark.createDataFrame([], "clip_id long, toxic int"), spark.createDataFrame([], "entry string"))
    assert abuse.score_clips(df, empty).count() == 3


# 5: look-alikes


SPELLER = lookalike.Speller(dict(lookalike.script_pairs(lookalike.Counter("the cop story shop audience рука вода корова сорт".split()))))


@pytest.mark.parametrize("a,b", [
    ("Тhе stоry", "The story"), ("Ｔｈｅ story", "The story"), ("st­ory​", "story"), ("the story", "the story"), ("éte", "éte"),
    ("е́te", "éte"), ("ﺷﺮﺡ", "شرح"), ("حتی", "حتى"), ("یقول", "يقول"), ("ﬁlm", "film"), ("！", "!"), ("cоp", "сop"), (" a ", "a"),
])
def test_same_look(a, b):
    assert SPELLER.text(a) == SPELLER.text(b)


@pytest.mark.parametrize("a,b", [("cafe", "café"), ("Story", "story"), ("x²", "x2"), ("a b", "ab"), ("a.", "a!"), ("أن", "ان"), ("👨‍👩‍👧", "👨👩👧"), ("يقول", "ىقول")])
def test_other_look(a, b):
    assert SPELLER.text(a) != SPELLER.text(b)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aоoсcеe xрpТT́", max_size=14), st.randoms())
def test_twins_get_one_form(text, rnd):
    twin = "".join(rnd.choice(lookalike._TWINS.get(c, c)) for c in text)
    assert SPELLER.text(text) == SPELLER.text(twin) and SPELLER.text(SPELLER.text(text)) == SPELLER.text(text)


def test_script_follows_the_corpus():
    assert SPELLER.text("рука") == "рука" and SPELLER.text("audіenсe") == "audience"


def test_look_alike_pairs(spark):
    data = [("t", 1, "A b"), ("t", 2, "А b"), ("t", 3, "A b"), ("t", 4, "A b"), ("t", 5, None), ("u", 6, "A b"), ("t", 7, "a b")]
    df = spark.createDataFrame(data, "grp string, id long, text string")
    forms = df.withColumn("shown", lookalike.consistent_text(df, F.col("text"), lookalike.letter_scores(df))).select("grp", "id", F.md5("shown").alias("seen"), F.md5("text").alias("kept"))
    assert rows(lookalike.look_alike_pairs(forms)) == [("t", 1, 2), ("t", 1, 3), ("t", 2, 3), ("t", 2, 4), ("t", 3, 4)]
    assert lookalike.look_alike_pairs(forms.limit(0)).count() == 0


# 6: tokens


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.read_ranks(VOCABULARY))


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=80))
def test_ids_equal_the_library_and_round_trip(encoder, text):
    tokenizers = pytest.importorskip("tokenizers")
    global LIBRARY
    if "LIBRARY" not in globals():
        LIBRARY = tokenizers.Tokenizer.from_file(os.path.join(tokens.FOLDER, "byte_bpe_50k.json"))
        LIBRARY.encode_special_tokens = True
    ids = encoder.encode(text)
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids
    back = {i: b for b, i in encoder.ranks.items()}
    assert b"".join(back[i] for i in ids).decode("utf-8") == text


def test_long_piece(encoder):
    tiktoken = pytest.importorskip("tiktoken")
    text = "x1" + "abcde" * 3_000 + "é" * 500
    own = tiktoken.Encoding("own", pat_str=tokens.PIECES, mergeable_ranks=encoder.ranks, special_tokens={})
    assert encoder.encode(text) == own.encode_ordinary(text)


def test_ids_of_odd_rows(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "Hello"), (None, "Hello"), (3, "Hello")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    found = tokens.encode_corpus(df, "doc_id", "text").collect()
    assert [r.ids for r in found[:2]] == [[], []] and found[2].ids == found[4].ids == [15496]
    assert tokens.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


# 7: mixing


def test_pivot_keeps_mass_and_bounds():
    rng = np.random.default_rng(2)
    sizes, parts = rng.integers(0, 500, 2_000), np.full(2_000, 0.37)
    out = mix.pivot(np.arange(2_000), sizes, parts)
    open_ = (out > 0) & (out < 1)
    assert open_.sum() <= 1 and ((out >= 0) & (out <= 1)).all()
    assert abs((out * sizes).sum() - (parts * sizes).sum()) < 1e-3


def test_pivot_is_unbiased():
    sizes = np.array([10, 200, 35, 80, 5])
    mean = np.mean([mix.pivot(np.arange(5) + 1_000 * k, sizes, np.full(5, 0.5)) for k in range(3_000)], axis=0)
    assert np.abs(mean - 0.5).max() < 0.05


@pytest.mark.parametrize("leaf", [4_096, 16])
def test_mix(spark, monkeypatch, leaf):
    monkeypatch.setattr(mix, "LEAF", leaf)
    random.seed(1)
    data = [(i, "big" if i < 600 else "small" if i < 660 else None if i < 670 else "untargeted", random.randint(0, 400)) for i in range(700)]
    sized = spark.createDataFrame([*data, (None, "big", 5)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.2, 3), ("none", 0.1, 2)], "source string, weight double, max_repeats int")
    copies, plan = mix.mix_copies(sized, targets)
    found = copies.collect()
    assert len(found) == 660 and max(r.copies for r in found if r.source == "small") <= 3 and max(r.copies for r in found if r.source == "big") <= 1
    report = {r.source: r for r in mix.share_report(copies, targets, plan).collect()}
    assert abs(report["big"].actual_share - 0.7 / 0.9) < 0.01 and report["none"].taken_tokens == 0
    assert abs(report["small"].taken_tokens - report["small"].wanted_tokens) <= 400
    again, _ = mix.mix_copies(sized, targets)
    assert rows(copies) == rows(again)


def test_mix_of_nothing(spark):
    sized = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, weight double, max_repeats int")
    copies, plan = mix.mix_copies(sized, targets)
    assert copies.count() == 0 and rows(mix.share_report(copies, targets, plan).select("source", "actual_share")) == [("a", 0.0)]


# 8: languages


ENGLISH = ["The old teacher repeats the story while everyone is waiting.", "This morning the guest explains the plan with a smile.", "Nobody in the room forgets the price of fresh bread."]
GERMAN = ["Die alte Lehrerin wiederholt die Geschichte während alle warten.", "Heute Morgen erklärt der Gast den Plan mit einem Lächeln.", "Niemand im Raum vergisst den Preis für frisches Brot."]


def test_labels():
    for label, wanted in (("en_GB ", "en"), ("العربية", "ar"), ("DEU", "de"), ("n/a", ""), (None, ""), ("fa", "other"), ("Español", "es"), ("pt-BR", "pt"), ("mul", "")):
        assert langid.label_language(label) == wanted


def test_profiles_on_mixed_documents(spark):
    profiles = langid.Profiles.fit(ENGLISH * 3 + GERMAN * 3 + [GERMAN[0]], ["en"] * 9 + ["de"] * 9 + ["en"])
    data = [(1, " ".join(ENGLISH), "de"), (2, ENGLISH[0] + "\n" + GERMAN[1], "en"), (3, None, "en"), (4, "00:01 --> 00:02", None), (5, "", None), (None, GERMAN[2], "de")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumn("passages", F.lit("clash"))
    found = {r.doc_id: r for r in langid.detect(df, profiles).collect()}
    assert found[1].languages == ["en"] and sorted(found[2].languages) == ["de", "en"] and found[None].languages == ["de"]
    assert all(found[i].languages == [] and found[i].passages == [] for i in (3, 4, 5))
    assert [(p.lang, data[1][1][p.from_char : p.to_char]) for p in found[2].passages] == [("en", ENGLISH[0]), ("de", GERMAN[1])]
    assert all(0 < p.confidence <= 1 for p in found[2].passages)
    assert langid.detect(df.limit(0), profiles).count() == 0
    assert langid.detect(df, langid.fit_profiles(df.limit(0))).filter("size(languages) > 0").count() == 0


def test_short_foreign_passages_keep_their_language(spark):
    russian = ["Старая учительница рассказывает историю, пока все ждут.", "Сегодня утром гость объясняет план с улыбкой.", "Никто в комнате не забывает цену свежего хлеба."]
    profiles = langid.Profiles.fit(ENGLISH * 3 + GERMAN * 3 + russian * 3, ["en"] * 9 + ["de"] * 9 + ["ru"] * 9)
    names, part = ["de", "en", "ru"], ([0.1, 0.9, 0.0], [0.05, 0.01, 0.3], [0.2, 0.19, 0.01], [0.9, 0.1, 0.0])
    spans, letters = [(0, 60), (61, 67), (68, 80), (81, 140)], [" " * 60, " привет ", " so die ", " " * 60]
    found, _, cut = langid._document(spans, [9, 1, 2, 9], letters, np.array(part), names)
    assert found == ["de", "en"] and [(p["lang"], p["from_char"], p["to_char"]) for p in cut] == [("en", 0, 60), ("ru", 61, 67), ("en", 68, 80), ("de", 81, 140)]
    text = f"{ENGLISH[0]}\nвсе ждут гость\n{ENGLISH[1]}"
    row = langid.detect(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string"), profiles).first()
    assert [p.lang for p in row.passages] == ["en", "ru", "en"]


def test_cosines_are_those_of_the_bundles():
    profiles = langid.Profiles.fit(ENGLISH + GERMAN, ["en"] * 3 + ["de"] * 3)
    text = langid.letters_of(ENGLISH[1])[0]
    grams, _ = langid.packed([text])
    bundle = langid.Space().grams(grams).astype(float).sum(axis=0)
    exact = profiles.vectors @ bundle / np.linalg.norm(bundle)
    assert np.abs(langid.Scorer(profiles).cosines([text])[0] - exact).max() < 0.03
