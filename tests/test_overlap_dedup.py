import hashlib
import itertools
import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quern.operators import dedup, overlap, selection


def words(n, at=0):
    return " ".join(f"w{k}" for k in range(at, at + n))


def test_containment_boundaries(spark, rows):
    # 20 words have 16 shingles; 12 shared words share 8 of them: exactly 8 at exactly one half.
    cases = spark.createDataFrame([(1, words(20)), (2, words(11, 500))], "item_id long, text string")
    docs = spark.createDataFrame([(1, words(12)), (2, words(11)), (3, words(11, 500)), (4, None), (5, "")], "doc_id long, text string")
    found = rows(overlap.containment(docs, cases), "doc_id", "item_id", "common", "containment")
    assert found == [(1, 1, 8, 0.5)]  # 7 shared at 100 % don't match


def test_exact_rule(spark, rows):
    needle = "alpha beta gamma delta epsilon zeta etas"  # 40 characters
    cases = spark.createDataFrame([(1, f"  {needle} "), (2, needle[:39]), (3, needle), (4, "x" * 45)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"Pre{needle.upper()}post"), (2, "none"), (3, "a" + "x" * 60)], "doc_id long, text string")
    assert rows(overlap.exact_containment(docs, cases)) == [(1, 1), (1, 3), (3, 4)]


def test_needles_and_exclusion(spark, rows):
    docs = spark.createDataFrame([(1, "See Fix-Git_42!"), (2, "nothing"), (3, None)], "doc_id long, text string")
    needles = spark.createDataFrame([("fixgit42",), ("",), ("git",), (None,), ("-!",), ("Fix-Git 42",)], "needle string")
    found = overlap.needle_matches(docs, needles, "doc_id", "text")
    assert rows(found) == [(1, "fixgit42"), (1, "git")]
    assert overlap.needle_matches(docs, needles.limit(0), "doc_id", "text").count() == 0 == overlap.needle_matches(docs.limit(0), needles, "doc_id", "text").count()
    gone = overlap.exclusions(found.select("doc_id"), docs.where("doc_id = 2").select("doc_id"))
    assert rows(overlap.exclude(docs, gone, "doc_id"), "doc_id") == [(3,)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exact_rule_by_minimizers(spark, rows):
    """Long words, cases that begin alike, copies of cases, wide characters and rows just too short, against a plain search."""
    rng = random.Random(2)
    word = "q" * 20 + "".join(rng.choice("abc") for _ in range(40))  # one word of 60 letters
    head = "the same instructions stand before each of the cases in this suite: "
    cases = [(1, word), (2, word), (2, head + "two"), (3, head + "three"), (4, "ÄÖÜ" * 14), (5, None), (6, " " * 50), (7, "x" * 40), (8, "short"), (9, "y" * 39 + "z"), (None, head + "two")]
    docs = [(k, t) for k, t in enumerate([f"a{word}b", word[1:], head + "TWO and three", head + "three", "äöü" * 14, "äöü" * 13 + "äö", None, "", "x" * 40, "x" * 39, "y" * 5000 + "z", (head + "two ") * 50, " ".join(rng.choice("abc") for _ in range(3000))])]
    left = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    right = spark.createDataFrame(cases, "item_id long, text string")
    found = overlap.exact_containment(left, right)
    held = {(c, t.strip(" ").lower()) for c, t in cases if t and len(t.strip(" ")) >= 40}
    assert rows(found) == sorted({(i, c) for i, t in docs if t for c, n in held if n in t.lower()}, key=repr)
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)
    assert overlap.exact_containment(left, right.limit(0)).count() == 0 == overlap.exact_containment(left.limit(0), right).count()


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("ab", max_size=60), max_size=12), st.lists(st.text("ab", min_size=1, max_size=40), max_size=12))
def test_needles_against_plain(spark, texts, needles):
    left = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = overlap.needle_matches(left, spark.createDataFrame([(n,) for n in needles], "needle string"), "doc_id", "text")
    assert {tuple(r) for r in found.collect()} == {(i, n) for i, t in enumerate(texts) for n in needles if n in t}


def test_many_needles_without_python(spark):
    needle = lambda k: hashlib.md5(str(k).encode()).hexdigest()
    needles = spark.range(100_000).selectExpr("if(id % 5 = 0, substring(md5(string(id)), 1, 10), md5(string(id))) AS needle")
    wanted = [0, 7, 99_999, 50_000, 1_234]
    texts = [(k, f"Trajectory-{needle(i)[:16]}_{needle(i)[16:]}/log ") for k, i in enumerate(wanted)] + [(9, needle(100_001) * 3)]
    found = overlap.needle_matches(spark.createDataFrame(texts, "doc_id long, text string"), needles, "doc_id", "text")
    assert {(k, n) for k, n in found.collect()} >= {(k, needle(i)[: 10 if i % 5 == 0 else 32]) for k, i in enumerate(wanted)}
    assert all(n in t.replace("-", "").replace("_", "").lower() for k, n in found.collect() for j, t in texts if j == k)
    assert not re.search("Python|Arrow|Pandas|NestedLoop|Cartesian", plan_of(found))


def brute_keep(texts, percent=85):
    sets, kept, out = {}, [], {}
    for i, t in texts:
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(0, len(w) - 4))}
        near = sets[i] and any(100 * len(sets[i] & sets[k]) >= percent * len(sets[i] | sets[k]) for k in kept if sets[k])
        out[i] = not near
        if not near:
            kept.append(i)
    return out


def test_greedy_chain(spark):
    # a is near b, b is near c, a isn't near c: a and c stay, components would keep only a
    base = [f"w{k}" for k in range(104)]
    a, b = list(base), list(base)
    b[0:8] = [f"x{k}" for k in range(8)]
    c = list(b)
    c[96:104] = [f"y{k}" for k in range(8)]
    texts = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c)), (4, "few words"), (5, "few words"), (6, " ".join(a))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r["kept"] for r in dedup.greedy_keep(df, "doc_id", "text").collect()}
    assert got == brute_keep(texts) == {1: True, 2: False, 3: True, 4: True, 5: True, 6: False}


def test_greedy_against_loop(spark):
    rng = random.Random(5)
    texts = []
    for i in range(60):
        w = [f"w{k}" for k in range(60)] if i % 3 else [f"v{i}_{k}" for k in range(60)]
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"z{rng.randrange(4)}"
        texts.append((i, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    pairs = {(r["left_id"], r["right_id"]) for r in dedup.similar_pairs(dedup.shingle_classes(df, "doc_id", "text"), "doc_id").collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(56)} for i, t in texts}
    heads = {i for i in sets if not any(sets[j] == sets[i] for j in sets if j < i)}
    assert pairs == {(a, b) for a, b in itertools.combinations(sorted(heads), 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert {r["doc_id"]: r["kept"] for r in dedup.greedy_keep(df, "doc_id", "text").collect()} == brute_keep(texts)


def loop_fold(rows, budgets, near):
    seen, kept, out = set(), set(), []
    for source, short, long in budgets:
        target, spent = {"short": short, "long": long}, {"short": 0, "long": 0}
        for s, _, i, identity, a, b in sorted(r for r in rows if r[0] == source):
            if all(spent[k] >= target[k] for k in target):
                break
            if identity in seen or any((i, k) in near or (k, i) in near for k in kept):
                continue
            got = {k: n for k, n in (("short", a), ("long", b)) if n is not None and spent[k] < target[k]}
            if got:
                best = max(got, key=lambda k: (target[k] - spent[k]) / target[k])
                spent[best] += got[best]
                seen.add(identity)
                kept.add(i)
                out.append((i, best, got[best]))
    return sorted(out)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 3), st.one_of(st.none(), st.integers(1, 9)), st.one_of(st.none(), st.integers(10, 30))), max_size=25), st.sets(st.tuples(st.integers(0, 24), st.integers(0, 24)), max_size=8))
def test_selection_against_loop(spark, made, near):
    rows = [(s, k, k, f"t{t}", a, b) for k, (s, t, a, b) in enumerate(made)]
    near = {(a, b) for a, b in near if a < b}
    budgets = [("a", 12, 40), ("b", 10, 30)]
    df = spark.createDataFrame(rows, "source string, place long, row_id long, identity string, short_tokens int, long_tokens int")
    pairs = spark.createDataFrame(sorted(near), "left_id long, right_id long")
    got = selection.select_corpus(df, pairs, [selection.Budget(*b) for b in budgets])
    assert sorted(tuple(r) for r in got.select("row_id", "bucket", "tokens").collect()) == loop_fold(rows, budgets, near)


def test_corpus_selection_with_copies(spark, tmp_path):
    # The whole query against a pass that compares each candidate with all accepted ones.
    from quern.plans import catalog

    rng = random.Random(3)
    docs = []
    for family in range(8):
        base = [f"f{family}w{k}" for k in range(90 + 4 * family)]
        near = ["changed", *base[1:]]  # Jaccard of over 0.85
        for text in (" ".join(base), " ".join(base), " ".join(base).upper(), ", ".join(base), " ".join(near), " ".join(near), "! ".join(near)):
            docs.append(text)
    docs += ["- " * 70, "- " * 70, "+ " * 70]  # without shingles: compared by identity only
    rng.shuffle(docs)
    table = [(k, text, "en", f"src{rng.randrange(3)}", len(text)) for k, text in enumerate(docs)]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in catalog.QUERIES["corpus_selection"](spark, str(tmp_path)).collect())

    seen, kept, expected = set(), [], []
    for source in [f"src{k}" for k in range(20)]:
        target, spent = {"short": 2000, "long": 3000}, {"short": 0, "long": 0}
        for i, text in sorted(((i, t) for i, t, _, s, _ in table if s == source), key=lambda x: (hashlib.md5(f"42:{x[0]}".encode()).hexdigest(), x[0])):
            if all(spent[b] >= target[b] for b in target):
                break
            w = re.findall(r"\w+", text.lower())
            grams = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
            if text in seen or grams and any(len(grams & k) >= 0.85 * len(grams | k) for k in kept):
                continue
            n = len(re.findall(r"\w+|[^\s\w]", text))
            fits = [b for b, low, high in (("short", 64, 511), ("long", 512, 2048)) if low <= n <= high and spent[b] < target[b]]
            if fits:
                spent[fits[0]] += n
                seen.add(text)
                kept.append(grams)
                expected.append((i, fits[0], n))
    assert got == sorted(expected)
    assert len(got) == 10  # one of each family and two without shingles


def test_clearance(spark):
    own = spark.createDataFrame([("c",)], "corpus_digest string")
    reports = spark.createDataFrame([("p", "c", "ok", "ok", 0)], "name string, corpus_digest string, status string, expected_status string, unresolved_overlaps long")
    cases = spark.createDataFrame([("a", 1, 1)], "suite string, expected long, observed long")
    assert overlap.clearance(own, reports, cases).isEmpty()
    digest = overlap.corpus_digest(spark.range(5), ["id"]).first()["corpus_digest"]
    assert digest == overlap.corpus_digest(spark.range(5).orderBy("id", ascending=False), ["id"]).first()["corpus_digest"]
