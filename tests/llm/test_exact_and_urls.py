import hashlib
import math
import re
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import exact_dedup, queries, url_filter

DOCS = "doc_id long, text string, digest string, keep_id long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", -1) for i, t in rows], DOCS)


def test_exact_groups_match_brute_force(spark):
    rows = [(5, "a  b"), (3, "a\tb"), (9, "a b "), (7, None), (8, ""), (2, "hot")] + [(100 + k, "hot") for k in range(40)] + [(5, "a  b"), (None, "hot"), (None, "x")]
    got = exact_dedup.exact_groups(docs(spark, rows), support=0.1).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    size = Counter(norm(t) for _, t in rows)
    least = {}
    for i, t in rows:
        if i is not None:
            least[norm(t)] = min(i, least.get(norm(t), i))
    want = sorted((str(i), hashlib.sha256(norm(t).encode()).hexdigest(), str(least.get(norm(t))), size[norm(t)], i == least.get(norm(t))) for i, t in rows)
    assert sorted((str(r["id"]), r["digest"], str(r["keep_id"]), r["group_size"], r["kept"]) for r in got) == want


def test_heavy_digests_are_all_found_and_bounded(spark):
    rows = docs(spark, [(k, "hot" if k % 3 else f"t{k}") for k in range(600)])
    heavy = exact_dedup.heavy_digests(exact_dedup.text_digests(rows), 0.05).collect()
    assert [(r["keep_id"], r["group_size"]) for r in heavy] == [(1, 400)]


def test_dropping_copies_keeps_columns_and_empty_tables(spark):
    out = exact_dedup.drop_exact_copies(docs(spark, [(1, "a"), (2, "a"), (3, "b"), (None, "a")]))
    assert out.columns == ["doc_id", "text", "digest", "keep_id"] and sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "3", "None"]
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0


def test_dropping_copies_names_rows_by_id_and_text(spark):
    out = exact_dedup.drop_exact_copies(docs(spark, [(3, "a"), (5, "a"), (5, "b"), (7, "c"), (7, "c"), (7, "c "), (8, "c"), (None, "a"), (None, "a")]))
    assert sorted(str((r["doc_id"], r["text"])) for r in out.collect()) == sorted(map(str, [(3, "a"), (5, "b"), (7, "c"), (7, "c "), (None, "a"), (None, "a")]))


PAGES = "page_id long, url string, rule string, score double"


def judged(spark, urls):
    rows = spark.createDataFrame([(k, u, "clash", 0.0) for k, u in enumerate(urls)], PAGES)
    return {r["id"]: r for r in url_filter.judge(rows, queries.URL_RULES).collect()}


def test_hosts_paths_and_rules(spark):
    urls = ["HTTP://WWW.Example.COM/en/x?q=/", "http://example.com/en/", "http://a.example.com/fr", "http://b.net/es/1#/", "http://b.net/EN/", None, "", "no scheme", "http://com", "http://evilnet/es/", "x://y?z"]
    got = judged(spark, urls)
    assert [got[k]["rule"] for k in range(11)] == ["www.example.com/en/", "example.com/en/", "com/", "net/es/", None, None, None, None, None, None, None]
    assert [(got[k]["host"], got[k]["path"]) for k in (0, 3, 7, 8, 10)] == [("www.example.com", "/en/x"), ("b.net", "/es/1"), ("", ""), ("com", ""), ("y", "")]
    assert got[0]["verdict"] == "allow" and got[1]["verdict"] == "block" and {r["verdict"] for r in got.values()} <= {"allow", "block"}


def test_scores_match_a_plain_model(spark):
    urls = [f"http://good{k % 7}.com/a/{k}" for k in range(60)] + [f"http://bad{k % 5}.net/fr/{k}-pills" for k in range(40)] + ["http://good1.org/a/5", "http://bad2.org/x-pills", "http://good1.org/a/5"]
    got = judged(spark, urls)
    rows = [(sym(u), got[k]["rule"] is not None and got[k]["verdict"] == "allow", got[k]["rule"] is not None) for k, u in enumerate(urls)]
    score = model([(s, a) for s, a, known in rows if known])
    for k, (s, _, _) in enumerate(rows):
        assert math.isclose(got[k]["score"], score(s), abs_tol=2e-9)
    assert got[100]["verdict"] == got[102]["verdict"] == "allow" and got[101]["verdict"] == "block"


def sym(url):
    return "^" * url_filter.ORDER + re.sub(r"[^a-z0\-./:?#=&_%]", "~", re.sub(r"\d", "0", url.lower())) + "$"


def model(rows):
    """The same definitions over dictionaries."""
    n, total = Counter(), Counter()
    for s, a in rows:
        for at in range(url_filter.ORDER, len(s)):
            total[a] += 1
            for k in range(url_filter.ORDER + 1):
                n[a, s[at - k : at], s[at]] += 1
                n[a, s[at - k : at], None] += 1
    kept = {c for (a, c, ch), m in n.items() if ch is None and m * url_filter.MAX_CONTEXTS >= total[a]} | {""}

    def p(a, c, ch):
        q = p(a, c[1:], ch) if c else 1 / len(url_filter.SYMBOLS)
        return (n[a, c, ch] + url_filter.PRIOR * q) / (n[a, c, None] + url_filter.PRIOR)

    def score(s):
        out = []
        for at in range(url_filter.ORDER, len(s)):
            c = next(s[at - k : at] for k in range(url_filter.ORDER, -1, -1) if s[at - k : at] in kept)
            out.append(math.log(p(True, c, s[at])) - math.log(p(False, c, s[at])))
        return sum(out) / len(out)

    return score


def test_rare_contexts_count_however_many_urls_there_are(spark):
    urls = [f"http://good{k % 7}.com/a/{k}" for k in range(300)] + [f"http://bad{k % 5}.net/fr/{k}-pills" for k in range(300)]
    urls += ["http://zebra.com/quartz/"] * 3 + ["http://bad.net/fr/jukebox/"] * 3 + ["http://zebra.org/quartz/", "http://jukebox.org/", "http://unseen.org/vwx"]
    got = judged(spark, urls)
    n = Counter()
    for k, u in enumerate(urls):
        s = sym(u)
        for at in range(url_filter.ORDER, len(s)) if got[k]["rule"] else ():
            for i in range(url_filter.ORDER + 1):
                n.update([(got[k]["verdict"], s[at - i : at], s[at]), (got[k]["verdict"], s[at - i : at], None)])

    def p(verdict, c, ch):
        q = p(verdict, c[1:], ch) if c else 1 / len(url_filter.SYMBOLS)
        return (n[verdict, c, ch] + url_filter.PRIOR * q) / (n[verdict, c, None] + url_filter.PRIOR)

    for k, u in enumerate(urls):
        s = sym(u)
        parts = [math.log(p("allow", s[at - 4 : at], s[at])) - math.log(p("block", s[at - 4 : at], s[at])) for at in range(4, len(s))]
        assert math.isclose(got[k]["score"], sum(parts) / len(parts), abs_tol=2e-9)
    assert got[606]["verdict"] == "allow" and got[607]["verdict"] == "block"


def test_threshold_is_the_middle_of_the_best_gap(spark):
    import random

    rng = random.Random(5)
    for _ in range(4):
        rows = [(round(rng.gauss(0.3, 0.4), 3), rng.randrange(4), 0) for _ in range(30)] + [(round(rng.gauss(-0.3, 0.4), 3), 0, rng.randrange(4)) for _ in range(30)] + [(9.0, 0, 0)]
        got = url_filter.threshold(spark.createDataFrame(rows, "score double, yes long, no long")).first()["cut"]
        steps = sorted({math.floor(s * url_filter.STEPS) for s, y, n in rows if y or n})
        yes, no = sum(r[1] for r in rows), sum(r[2] for r in rows)
        error = lambda k: round(sum(y / yes if math.floor(s * url_filter.STEPS) < k else n / no if math.floor(s * url_filter.STEPS) >= k else 0 for s, y, n in rows if y or n), 9)  # noqa: E731, B023
        errors = [error(k) for k in steps]
        at = errors.index(min(errors))
        below = steps[at - 1] + 1 if at else steps[at]
        assert math.isclose(got, (steps[at] + below) / 2 / url_filter.STEPS)


def test_a_hot_url_is_looked_up_where_it_is(spark):
    rows = [(k, "http://a.com/en/x" if k % 3 else f"http://b{k}.net/es/") for k in range(300)] + [(None, None)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), queries.URL_RULES).collect()
    assert len(got) == 301 and len({r["id"] for r in got}) == 301 and all(r["score"] is not None for r in got)


def test_urls_of_one_class_or_none(spark):
    assert judged(spark, []) == {}
    assert {r["verdict"] for r in judged(spark, ["http://a.org/", None]).values()} == {"allow"}
    assert judged(spark, ["http://a.com/", "http://a.org/"])[1]["verdict"] in ("allow", "block")


def test_native_queries_run_no_python(spark):
    rows = spark.createDataFrame([(1, "http://a.com/", "r", 0.0)], PAGES)
    for frame in (url_filter.judge(rows, queries.URL_RULES), exact_dedup.exact_groups(docs(spark, [(1, "a")]))):
        assert not re.search("Python|Arrow|Pandas", frame._jdf.queryExecution().toString())
    assert rows.select(F.lit(1)).count() == 1
