import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfscan.llm import components, encoding, mojibake, near, neighbours, packing, scans, survivor, topics

WORDS = "alpha beta gamma delta kettle ledger orbit museum window garden silver paper candle river stone cloud bread market".split()


def text(rng, n=80):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n))


# --- p1 ---------------------------------------------------------------------------------

CASES = [
    ("cp1252", "utf-8", "Später prüft die Köchin den überarbeiteten Entwurf – “alles”"), ("cp1251", "utf-8", "“Each résumé” is Wynfyrdu’s – so far, the café"), ("cp1250", "utf-8", "coração e situação, também não há"),
    ("cp437", "utf-8", "Bitte Allergie prüfen: die Schränke und Größe"), ("mac_roman", "utf-8", "le pâtissier répare la fenêtre près du comptoir"), ("cp1252", "cp1251", "Наш старый фонарь тянет весь скромный мешок"),
    ("latin_1", "koi8_r", "Наш старый фонарь тянет весь скромный мешок"), ("cp1251", "koi8_r", "Кратко : проверьте мешок и фонарь сегодня"), ("cp866", "cp1251", "Наш старый фонарь тянет весь скромный мешок"), ("latin_1", "iso8859_2", "porządkuje łąka śledzi wśród świeży, łączy tamten"),
]


@pytest.mark.parametrize("read, written, original", CASES)
def test_restores(read, written, original):
    raw = original.encode(written)
    garbled = "".join(mojibake.DECODE[read][b] for b in raw)
    got, found = mojibake.repair("Clean line – fine.\n" + garbled)
    assert found
    if written == "utf-8" or read == "cp1252":
        assert got == "Clean line – fine.\n" + original


@pytest.mark.parametrize("read, written, original", [
    ("cp1250", "cp852", "Żaden zima nie opóźnia odpowiedź, młody balkon zastępuje żółty gwóźdź"), ("cp1252", "iso8859_5", "Наш старый фонарь тянет весь скромный мешок"),
    ("cp1251", "mac_cyrillic", "Наш старый фонарь тянет весь скромный мешок"), ("cp866", "iso8859_5", "Наш старый фонарь тянет весь скромный мешок"),
])
def test_restores_from_every_page(read, written, original):
    garbled = "".join(mojibake.DECODE[read][b] for b in original.encode(written))
    assert mojibake.repair(garbled) == (original, True)
    assert all(b in mojibake.COMMON[a] or b in mojibake.SELDOM[a] for a in mojibake.PAGES for b in mojibake.PAGES if a != b)


def test_what_is_never_meant_is_found(monkeypatch):
    monkeypatch.setattr(mojibake, "_accepted", lambda *_: {})
    assert mojibake.repair("m\x88ody") == ("m\x88ody", True)


def test_escapes_zeros_and_pages_of_two_bytes():
    r = mojibake.repair
    assert r("Das Caf&Atilde;&copy; ist zu") == ("Das Café ist zu", True)
    assert r("prÃªt, Caf&Atilde;&copy; &amp; Co") == ("prêt, Café &amp; Co", True)
    for clean in ("caf&eacute; &amp; bar", "a &copy; b", "x &mdash; y", "AT&T; R&D"):
        assert r(clean) == (clean, False)
    for page in mojibake.WIDE:
        assert r("Please check it\nand more".encode(page).decode("latin_1")) == ("Please check it\nand more", True)
    for page, text in (("gbk", "Наш старый фонарь"), ("shift_jis", "Наш фонарь"), ("cp1253", "prêt à créer"), ("cp1254", "Größe prüfen")):
        raw = text.encode()
        garbled = raw.decode(page, "replace") if page in mojibake.DOUBLE else "".join(mojibake.DECODE[page][b] for b in raw)
        got, found = r(garbled)
        assert found and ("\ufffd" in garbled or got == text), page


def test_every_unseen_state_is_queued(monkeypatch):
    """A reading is found though the step before it costs more than what it came from."""
    read = lambda t: t.encode().decode("cp1252")
    once, plain = read("prêt"), mojibake.plausibility
    twice = read(once)
    dear = plain(twice)[0] * 1.4
    monkeypatch.setattr(mojibake, "plausibility", lambda t: (dear, dear) if t == once else plain(t))
    best, after, before = mojibake.restore((twice,), steps=2, uphill=1.5)
    assert best == ("prêt",) and after < before < dear
    assert mojibake.restore((twice,), steps=2, uphill=1.0)[0] != ("prêt",)


def test_restores_twice_and_wide():
    twice = "prêt à créer un modèle".encode().decode("cp1252", "ignore").encode().decode("cp1252", "ignore")
    assert "modèle" in mojibake.repair(twice)[0]
    wide = "Please check the itinerary and the ceiling".encode().decode("utf-16-le")
    assert mojibake.repair(wide) == ("Please check the itinerary and the ceiling", True)
    assert mojibake.repair("ï»¿Тот фонарь") == ("Тот фонарь", True)
    assert mojibake.repair("caf�") == ("caf�", True)


@pytest.mark.parametrize("clean", [
    "", "plain", "Ω ≥ µ · ½ © SÃO TOMÉ", "IRMÃ ½ ± 3 °C Åse ÂNGULO MANHÃ", "σβδφπμ χεχαιη ατζτ", "ぺしにがぐ はすぶふゎちむ てごそぱじ 東京", "搠獥沑抸莛蔃厗", "셐뀭째쮏", "┌──┬──┐\n│ 417 │ 463 │\n└──┴──┘", "żółty ciężar łączy wśród źdźbło",
    "Наш НЕСЁТ коллега, объём", "coração não é ação; naïve façade, L’équipe “dit” – déjà", "pres\xad\nent pré¬\nsent", "¿quién? ¡sí! €5 §7 £3", "ﬁrst ﬂight", "áé",
])
def test_meant_so_is_no_case(clean):
    assert mojibake.repair(clean) == (clean, False)


def test_garbled_operator(spark):
    rows = [(1, "prÃ©coce"), (2, None), (3, ""), (4, "ok"), (None, "aÃ±o"), (1, "prÃ©coce"), (5, "x" * 500_000 + " Ã¼ber"), (6, "é")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, body string, found int")
    got = mojibake.garbled(df).collect()
    assert sorted((r["id"] or 0, r["body"][-7:]) for r in got) == [(0, "año"), (1, "précoce"), (1, "précoce"), (5, "xx über")]
    assert mojibake.garbled(df.limit(0)).count() == 0


# --- p2 ---------------------------------------------------------------------------------


def groups_of(pairs, ids):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b and a in ids and b in ids:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in parent}


def graphs():
    rng = random.Random(3)
    star = [(0, i) for i in range(1, 60)]
    chain = [(1000 + i, 1001 + i) for i in range(150)]
    rng.shuffle(chain)
    labels = list(range(2000, 2100))
    rng.shuffle(labels)
    mixed = list(zip(labels, labels[1:])) + [(rng.randrange(3000, 3200), rng.randrange(3000, 3200)) for _ in range(120)]
    tail = [(59, 500)] + [(500 + i, 501 + i) for i in range(30)]  # a chain on the star: peeling stops on it
    dirty = [(5, 5), (None, 3), (7, None), (1, 0), (0, 1), (77777, 1)]
    return [star + chain + dirty, mixed, star + tail + mixed, [(9, 9), (None, 1)], []]


@pytest.mark.parametrize("k", range(5))
def test_components(spark, k):
    pairs = graphs()[k]
    known = {x for p in pairs for x in p if x is not None} - {77777}
    df = spark.createDataFrame([(a, b, 1) for a, b in pairs], "id_a long, id_b long, a int")
    ids = spark.createDataFrame([(x,) for x in known] + [(None,)], "id long")
    got = {r["id"]: r["group_id"] for r in components.group_ids(df, ids).collect()}
    assert got == groups_of(pairs, known)


# --- p3 ---------------------------------------------------------------------------------


def test_survivors(spark, make_files):
    roots = spark.createDataFrame([("/r", 1.0), (None, 2.0)], "path string, id double")
    good = {"size": 5, "mtime": 4e8, "indexed": 5e8, "fhash": "Ab"}
    f = make_files(
        {"id": 9, "path": "/x/1"} | good, {"id": 8, "path": "/r/2"} | good | {"size": 0}, {"id": 7, "path": "/r/3"} | good | {"mtime": 6e8, "fhash": "aB"}, {"id": 6, "path": "/r/4"} | good,
        {"id": 5, "path": "/r/5"} | good | {"is_dir": 1}, {"id": 4, "path": "/r/6", "fhash": "one"}, {"id": 3, "path": None, "fhash": "nul"}, {"id": 2, "path": None, "fhash": "NUL"}, {"id": 1, "fhash": None}, {"id": 6, "path": "/r/4"} | good,
        {"id": 20, "path": "/r/t1"} | good | {"fhash": "tie"}, {"id": 19, "path": "/r/t2"} | good | {"fhash": "tie"}, {"id": None, "path": "/r/t3"} | good | {"fhash": "tie"},
    ).withColumn("root", F.lit(1))
    assert sorted(map(tuple, survivor.survivors(f, roots).collect())) == [(2, 2), (6, 6), (19, 19)]
    assert survivor.survivors(f.limit(0), roots).count() == 0


def test_survivor_plan_cuts_groups_before_the_shuffle(spark, make_files):
    plan = survivor.survivors(make_files({"fhash": "a"}), spark.createDataFrame([], "path string"))._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


# --- p4 ---------------------------------------------------------------------------------


def shingle_sets(texts, width, least=200):
    out = {}
    for i, t in texts:
        if t is not None and len(t) >= least:
            w = re.findall(r"\w{2,}", t.lower())
            out[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
    return out


@pytest.mark.parametrize("width, share", [(3, 0.6), (5, 0.8)])
def test_similar_pairs(spark, width, share):
    rng = random.Random(5)
    texts = []
    for g in range(12):
        words = text(rng, rng.choice([40, 90])).split()
        for _ in range(4):
            w = list(words)
            for _ in range(rng.choice([0, 1, 3, 8])):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts.append((len(texts), " ".join(w)))
    texts += [(900, texts[0][1]), (901, texts[0][1]), (902, texts[0][1].upper()), (903, None), (904, ""), (905, "short"), (906, "a " * 300), (907, "a " * 300), (908, "one two" + " " * 300), (909, "é" * 250)]
    sets = shingle_sets(texts, width)
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] | sets[b]) and len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b])}
    df = spark.createDataFrame([(*t, 0) for t in texts], "id long, body string, rep int")
    got = list(map(tuple, near.similar_pairs(df, width, share).collect()))
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 10


def test_similar_empty_and_long(spark):
    df = spark.createDataFrame([(1, "word " * 50_000), (2, "word " * 50_001), (None, "word " * 100)], "id long, body string")
    assert list(map(tuple, near.similar_pairs(df, 3, 0.6).collect())) == [(1, 2)]
    assert near.similar_pairs(df.limit(0), 3, 0.6).count() == 0


@pytest.mark.parametrize("longest", [10_000, 20])
def test_long_lists_are_merged_in_full(longest):
    """A list longer than SHORT gives all its pairs, also when it spans batches; one longer than `longest` is passed on whole."""
    import pyarrow as pa

    n = 3 * near.SHORT
    h = np.array([1, 1] + [5] * n + [9], np.int64)
    ids = np.arange(len(h))
    batch = lambda s: pa.RecordBatch.from_arrays([pa.array(h[s]), pa.array(ids[s]), pa.array(np.full(len(h[s]), 10, np.int32))], ["h", "id", "n"])
    for cuts in ([20, 21], [40], [], [2, 50], range(1, n)):
        ends = [0, *cuts, len(h)]
        out = [tuple(r.values()) for b in near._merged(0.6, longest)([batch(slice(a, z)) for a, z in zip(ends, ends[1:])]) for r in b.select(["a", "b", "h"]).to_pylist()]
        inner = [(2 + a, 2 + b, None) for b in range(n) for a in range(b)] if n <= longest else [(2 + a, None, 5) for a in range(n)]
        assert sorted(out, key=str) == sorted([(0, 1, None)] + inner, key=str), cuts


def test_one_sequence_in_all_texts_and_one_text_a_third(spark, monkeypatch):
    """Lists and classes far beyond a block give the same pairs as brute force."""
    monkeypatch.setattr(near, "CLASS", 7)
    rng = random.Random(12)
    tail = " ".join(rng.choice(WORDS) for _ in range(60))
    texts = [(i, f"w{i} x{i} y{i} " * rng.choice([1, 4]) + tail + f" z{i % 9} q{i % 9} r{i % 9}") for i in range(60)] + [(100 + i, "the same text of all " * 12) for i in range(30)]
    sets = shingle_sets(texts, 3)
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    df = spark.createDataFrame(texts, "id long, body string")
    copies, links = near.similar_texts(df, 3, 0.6, longest=11)
    assert {tuple(r) for r in links.collect()} == {p for p in want if p[0] < 100} and copies.count() == 30
    assert {tuple(r) for r in near.similar_pairs(df, 3, 0.6).collect()} == want
    got = {r["id"]: (r["class_id"], r["copies"], r["links"]) for r in near.classes(df, 3, 0.6).collect()}
    assert got == {i: (min(i, 100), 30 if i >= 100 else 1, sum(i in p for p in want) if i < 100 else 0) for i, _ in texts}


# --- p6 ---------------------------------------------------------------------------------


def closest(rows, k, bits):
    out = set()
    for a, v in rows:
        near_ids = sorted((bin((v ^ w) & (2**64 - 1)).count("1"), b) for b, w in rows if b != a)[:k]
        out |= {(min(a, b), max(a, b)) for d, b in near_ids if d <= bits}
    return out


def test_neighbours(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(40)]
    rows = [(i, b ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(7)))) for i, b in enumerate(base * 12)]
    rows += [(1000 + i, base[0]) for i in range(30)]  # a class of copies
    rows = [(i, v - (1 << 64) if v >> 63 else v) for i, v in rows]
    df = spark.createDataFrame(rows + [(None, 5), (5000, None), rows[0]], "id long, v long").withColumn("n", F.lit(1))
    want, got = closest(rows, 5, 8), set(map(tuple, neighbours.neighbour_pairs(df, 5, 8).collect()))
    assert got <= want and len(got) >= 0.99 * len(want)
    assert neighbours.neighbour_pairs(df.limit(0), 5, 8).count() == 0
    copies = spark.createDataFrame([(i, 7) for i in range(8)], "id long, v long")
    assert set(map(tuple, neighbours.neighbour_pairs(copies, 5, 0).collect())) == closest([(i, 7) for i in range(8)], 5, 0)


@pytest.mark.parametrize("rows, depth", [(20_000, 8), (1_000_000, 14), (50_000_000, 19), (800_000_000, 23)])
def test_recall_of_the_forest_at_size(rows, depth):
    """Of random fingerprints with a neighbour planted at 8 bits, how often one end visits the leaf of the other; the sample is bounded, so trees
    of any depth can be tried with few rows."""
    rng = np.random.default_rng(1)
    v = rng.integers(-(2**63), 2**63 - 1, min(rows, 200_000))
    q = v[:500].copy()
    for i in range(500):
        for b in rng.choice(64, 8, replace=False):
            q[i] ^= np.int64(np.uint64(1) << np.uint64(b))
    forest = neighbours.Forest.fit(v[-neighbours.SAMPLE :], rows)
    there = lambda a, b: (forest.leaves(a)[np.arange(500)[:, None], forest.visits(b)[0]] == forest.visits(b)[1]).any(1)
    assert forest.depth == depth and (there(v[:500], q) | there(q, v[:500])).mean() >= 0.9
    sizes = np.bincount(forest.leaves(v[:100_000])[:, 0], minlength=1 << depth)
    assert depth > 15 or sizes.max() <= neighbours.HOT_LEAF * max(1, len(v[:100_000]) >> depth) + 20


def test_hot_leaves_are_met_in_blocks(spark, monkeypatch):
    """Fingerprints that no plane parts are all in one leaf; every pair of them is met, a block at a time."""
    monkeypatch.setattr(neighbours, "LEAF", 4)
    rng = random.Random(7)
    rows = [(i, sum(1 << b for b in rng.sample(range(64), 2))) for i in range(120)]
    rows = sorted({v - (1 << 64) if v >> 63 else v: (i, v - (1 << 64) if v >> 63 else v) for i, v in rows}.values())
    one = spark.createDataFrame([(v, 0) for _, v in rows], "v long, place long")
    got = {tuple(r) for r in neighbours._met(one, one.withColumnRenamed("v", "w"), 3).collect()}
    bits = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    assert got == {(a, b, bits(a, b)) for _, a in rows for _, b in rows if a != b and bits(a, b) <= 3}
    assert set(map(tuple, neighbours.neighbour_pairs(spark.createDataFrame(rows, "id long, v long"), 5, 8).collect())) == closest(rows, 5, 8)


def test_sample_does_not_grow_with_the_partitions(spark, monkeypatch):
    """What the stages send to the driver, with as many fingerprints in each of 16 partitions as the sample has."""
    monkeypatch.setattr(neighbours, "SAMPLE", 1000)
    rows = spark.range(16_000).select("id", F.xxhash64(F.lit(3), "id").alias("v"))
    sc, conf = spark.sparkContext, {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16", "spark.sql.files.openCostInBytes": "64m"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        sc.setJobGroup("sample", "sample")
        neighbours.neighbour_pairs(rows, 5, 8)
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("sample")]
        stages = [sc._jsc.sc().statusStore().lastStageAttempt(k) for j in jobs for k in j.stageIds]
        sent = [s.resultSize() for s in stages if s.name().startswith("collect")]
        assert sent and 0 < max(sent) < 200_000
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    want = [r["v"] for r in rows.orderBy(F.xxhash64("v"), "v").limit(1000).collect()]
    # also where the count promises more than there are, so the first look finds too few
    assert neighbours._sample(rows, 16_000) == neighbours._sample(rows, 64_000) == want
    assert sorted(neighbours._sample(rows.limit(7), 7)) == sorted(r["v"] for r in rows.limit(7).collect())


# --- p7 ---------------------------------------------------------------------------------


def test_glyph_edits():
    g = scans.glyph_edits
    assert g("corndor", "corridor") == 1 and g("staiibige", "staubige") == 1 and g("schrnale", "schmale") == 1 and g("nofe", "note") == 1 and g("we1che", "welche") == 1 and g("Hcfc", "Hefe") == 2
    assert g("house", "mouse") is None and g("same", "same") == 0
    assert scans.skeleton("corndor") == scans.skeleton("corridor") and scans.skeleton("Geordriet") == scans.skeleton("geordnet")


PAGE = """KETTLE REPORT 1966
The quiet kettle holds the ledger and the win-
dow beside the old garden, while the rnarket is
still open to every paper candle in the town and

KETTLE REPORT 1966
12
the river carries the stone below the bright mu-
seum. A new page of silver paper follows the old
one, and the cl0ud above the garden is gone.
KETTLE REPORT 1966
13
Nothing else was left of the bread."""


def test_repairs_a_page():
    got, found = scans.repair(PAGE, {"rnarket": [{"worth": 1.0, "word": "market", "v": None}]})
    assert found and got == (
        "The quiet kettle holds the ledger and the window beside the old garden, while the market is still open to every paper candle in the town and "
        "the river carries the stone below the bright museum. A new page of silver paper follows the old one, and the cloud above the garden is gone. Nothing else was left of the bread."
    )


@pytest.mark.parametrize("clean", [
    "", "one line", "A sentence.\n\n336\n57\n416\n267\n", "Orevo:\nHe said that all was quite well there.\n\nMira:\nShe said nothing of the kind at all.\n\nOrevo:\nThen he left.",
    "A plain line that goes on and on and\nanother that follows it for a while and\nthen a third that ends here at last.", "Draft 7\n\nA plain line that goes on and on and\nanother that follows it for a while and\nthen a third that ends.",
])
def test_no_scan(clean):
    assert scans.repair(clean, {}) == (clean, False)


def test_scanned_operator(spark):
    rng = random.Random(8)
    rows = [(i, text(rng, 60)) for i in range(60)]
    wrapped = lambda s: "\n".join(re.findall(r".{30,45}(?: |$)", s))
    rows += [(100, wrapped(text(rng, 60).replace("kettle", "kcttle"))), (101, wrapped(text(rng, 60))), (102, PAGE), (103, None), (104, ""), (None, PAGE), (105, "x\n" * 100_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, body string, rare int")
    got = {r["id"]: r["body"] for r in scans.scanned(df).collect()}
    assert got.keys() == {100, 102} and "kcttle" not in got[100]
    assert scans.scanned(df.limit(0)).count() == 0


def test_the_words_around_a_place_choose(spark):
    """One spelling stands for two words, and each place gets its own."""
    rng = random.Random(10)
    wrapped = lambda s: "\n".join(re.findall(r".{30,45}(?: |$)", s))
    sea, farm = "the old boat sails over deep water".split(), "each brown cow eats fresh grass".split()
    said = lambda words, w: " ".join(rng.sample(words, 3) + [w] + rng.sample(words, 3))
    docs = [" ".join(said(sea, "sternela") + " " + said(farm, "stemcla") for _ in range(6)) for _ in range(120)]
    rows = list(enumerate(docs)) + [(500, wrapped(said(sea, "sternela") * 3 + " " + said(sea, "sterncla") + " " + said(farm, "sterncla") + " " + said(farm, "stemcla") * 3))]
    options, model = scans.readings(spark.createDataFrame(rows, "id long, body string"))
    held = {r["rare"]: [o.asDict() for o in r["options"]] for r in options.collect()}
    assert {o["word"] for o in held["sterncla"]} == {"sternela", "stemcla"}
    pick = lambda words: scans.best_here(held["sterncla"], " ".join(words[:3] + ["sterncla"] + words[3:]), len(" ".join(words[:3])) + 1, len(" ".join(words[:3])) + 9, model)
    assert [pick(sea[:6]), pick(farm[:6])] == ["sternela", "stemcla"]
    like = {w: model.around(words) for w, words in (("sea", sea), ("farm", farm))}
    assert abs(like["sea"] @ like["farm"]) < 0.5 and model.turn.shape == (scans.BUCKETS, scans.DIMENSIONS)


def test_signs_at_the_edges_and_in_runs(spark):
    rng = random.Random(9)
    wrapped = lambda s: "\n".join(re.findall(r".{30,45}(?: |$)", s))
    rows = [(i, text(rng, 60) + " always still кратко NOTE bridge ledger wheel") for i in range(60)]
    odd = " 1edger whee1, sti11 @lways 0nly-8ridge! кратк0 8RIDGE 1984 1980s x@wheel.org hot! |3| still! "
    rows += [(100, wrapped(text(rng, 40) + odd + text(rng, 40)))]
    got = {r["id"]: r["body"] for r in scans.scanned(spark.createDataFrame(rows, "id long, body string")).collect()}
    assert got.keys() == {100}
    assert " ledger wheel, still always 0nly-bridge! кратко BRIDGE 1984 1980s " in got[100] and " hot! |3| still! " in got[100]
    assert scans.words_of("plain 1edger! 1980s a_b 12 x\ufffdy1") == ["plain", "1edger!", "1edger", "edger", "s", "a", "b"]


# --- p8 ---------------------------------------------------------------------------------

TEXTS = [
    "", None, "   ", "Hello world's  end\n\n\n x", "don't we'll I'M", "日本語 テキスト　全角", "a b c\x85d\x1ce", "<|endoftext|> x", "é" * 300, "12345 ½ ² Ⅷ", "\r\n\t\r\n  tail  ", "emoji 👩‍👩‍👧 🏳️‍🌈", "퟿\U0010ffff", "x" * 60_000, "word " * 30_000, "ᚠᛇᚻ  ​zero", "a\x00b", "'s'S 't",
]


def test_ids_are_the_tokenizer_s(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{encoding.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rng = random.Random(9)
    many = TEXTS + ["".join(rng.choice(" \n'sdt.,!?aAéß日1٣½_- 　") for _ in range(rng.randrange(60))) for _ in range(300)] + TEXTS[:5]
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(many)] + [(None, "null id", "")], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in encoding.token_ids(df, block_chars=20_000).collect()}
    for i, x in enumerate(many):
        assert got[i] == t.encode(x or "", add_special_tokens=False).ids, (i, x)
    assert got[None] == t.encode("null id").ids
    back = {r["doc_id"]: r["text"] for r in encoding.decoded(encoding.token_ids(df), encoding.pieces(spark)).collect()}
    assert all(back[i] == (x or "") for i, x in enumerate(many))
    assert encoding.token_ids(df.limit(0)).count() == 0


# --- p9 ---------------------------------------------------------------------------------


def test_containers(spark):
    rng = random.Random(10)
    sizes = [(i, rng.choice([rng.randrange(1, 400), rng.randrange(1, 2049), 5000, 2048, 4096])) for i in range(3000)] + [(9000, 0), (9001, None), (None, 7), (9002, 10_000_000)]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens int").withColumn("part", F.lit(1))
    rows = packing.containers(df, group=1000).collect()
    held, parts = defaultdict(int), defaultdict(list)
    for r in rows:
        held[r["container_id"]] += r["n_tokens"]
        parts[r["doc_id"]].append((r["part"], r["first_token"], r["n_tokens"]))
    assert max(held.values()) <= 2048
    for i, n in sizes:
        if i is not None and n:
            own = sorted(parts.pop(i))
            assert sum(p[2] for p in own) == n and len(own) == -(-n // 2048) and [p[1] for p in own] == [2048 * k for k in range(len(own))]
    assert not parts and sum(held.values()) / (2048 * len(held)) > 0.97
    assert packing.containers(df.limit(0)).count() == 0


def test_packing_is_balanced():
    sizes = np.sort(np.random.default_rng(2).integers(10, 300, 5000))[::-1]
    where = packing.pack(sizes)
    cost = np.bincount(where, packing.LINEAR * sizes + packing.QUADRATIC * sizes**2)
    assert np.bincount(where, sizes).max() <= packing.CAPACITY and cost.std() < 0.05 * cost.mean()


# --- p10 --------------------------------------------------------------------------------

LEXICON = {"Law": "court judge verdict appeal lawyer contract clause".split(), "sport": "goal match referee stadium league striker medal".split(), "food": "oven dough garlic recipe butter onion broth".split()}


def about(rng, shares, n=120):
    out = []
    for _ in range(n):
        s = rng.choices(list(shares), list(shares.values()))[0]
        pair = [rng.choice(LEXICON[s])] if s else []
        out.append(" ".join(["the", *pair, rng.choice(WORDS), "and", rng.choice(WORDS)]) + ".")
    return " ".join(out)


def test_subjects(spark):
    rng = random.Random(11)
    names = list(LEXICON)
    docs, truth = [], {}
    for i in range(400):
        kind = rng.random()
        if kind < 0.7:
            s = rng.choice(names)
            docs.append(about(rng, {s: 0.95, rng.choice(names): 0.05}))
            truth[i] = {s}
        elif kind < 0.9:
            a, b = rng.sample(names, 2)
            docs.append(about(rng, {a: 0.5, b: 0.5}))
            truth[i] = {a, b}
        else:
            docs.append(about(rng, {None: 0.99, rng.choice(names): 0.01}))
            truth[i] = set()
    docs += [None, "", "   "]
    d = spark.createDataFrame([(i, t, "src", 1) for i, t in enumerate(docs)] + [(None, docs[0], None, 1)], "doc_id long, text string, source string, subject int")
    wrong = [(i, "nonsense") for i in range(5)] + [(None, "Law"), (1, None)]
    labels = [(i, rng.choice([str.upper, str.lower, lambda x: f" {x} "])(s)) for i in range(0, 120) for s in truth[i]]
    lab = spark.createDataFrame(labels + labels[:20] + wrong, "doc_id long, subject string")
    subj = spark.createDataFrame([(n, "") for n in names] + [(None, "")], "subject string, about string")
    got = defaultdict(set)
    for r in topics.subjects_of(d, lab, subj).collect():
        got[r["doc_id"]].add(r["subject"])
    wrong_ones = [(sorted(truth[i]), sorted(got[i])) for i in truth if got[i] != truth[i]]
    right = len(truth) - len(wrong_ones)
    assert right >= 0.95 * len(truth), wrong_ones[:20]
    assert not got.keys() & {400, 401, 402, None}
    assert topics.subjects_of(d, lab.limit(0), subj).count() == topics.subjects_of(d.limit(0), lab, subj).count() == topics.subjects_of(d, lab, subj.limit(0)).count() == 0
