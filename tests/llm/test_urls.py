import itertools
import math
import random

from stemma.llm import urls
from stemma.llm.plans import URL_RULES


def best_split(seg, name):
    """All segmentations, the cheapest one."""
    unknown = math.log(seg.total / 10)
    cost = lambda w: seg.cost.get(w, unknown + len(w) * math.log(10))
    out = []
    for cuts in itertools.product([0, 1], repeat=len(name) - 1):
        words, at = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                words.append(name[at:i])
                at = i
        words.append(name[at:])
        out.append((sum(map(cost, words)), words))
    return min(out)


def test_viterbi_matches_all_segmentations():
    seg = urls.Segmenter({w: 5 + len(w) for w in urls.SEEDS})
    for name in ["cheappills", "freecasino", "newsworld", "xyzzyq", "mywebshop", "betsbets"]:
        cost, words = best_split(seg, name)
        got = seg.split(name)
        price = sum(seg.cost.get(w, math.log(seg.total / 10) + len(w) * math.log(10)) for w in got)
        assert "".join(got) == name and abs(price - cost) < 1e-9, (name, got, words)


def test_rules_and_method(spark):
    cases = [
        ("http://a.example.com/en/1", "example.com/en/", "block"),
        ("http://EXAMPLE.com/en/1?x#y", "example.com/en/", "block"),
        ("http://www.example.com/en/1", "www.example.com/en/", "allow"),
        ("http://notexample.com/en/", "com/", "allow"),
        ("http://a.com", None, "allow"),  # an empty path starts with no slash
        ("http://x.net/es/2", "net/es/", "block"),
        ("http://x.net/En/2", None, "allow"),
        ("http://net/fr/", "net/fr/", "block"),
        ("https://freecasinobets.org/a", None, "block"),
        ("https://quietgarden.org/a", None, "allow"),
        ("no scheme", None, "allow"),
        (None, None, "allow"),
        ("", None, "allow"),
        ("ftp://h?q://other/path", None, "allow"),
    ] + [("https://plain.org/page/%d" % i, None, "allow") for i in range(30)]
    df = spark.createDataFrame([(i, u, "kept", "old") for i, (u, _, _) in enumerate(cases)], "page_id long, url string, mark string, host string")
    got = {r.page_id: r for r in urls.judge(df, URL_RULES).collect()}
    for i, (u, rule, verdict) in enumerate(cases):
        assert (got[i].rule, got[i].verdict) == (rule, verdict), (u, got[i])
        assert got[i].mark == "kept"
    assert (got[1].host, got[1].path) == ("example.com", "/en/1")
    assert (got[4].host, got[4].path) == ("a.com", "")
    assert (got[10].host, got[11].host, got[13].host, got[13].path) == ("", "", "h", "")
    assert urls.judge(df.limit(0), URL_RULES).count() == 0


def test_more_words_than_travel_give_the_same(spark, monkeypatch):
    """Tables of words that are joined hold every word: same splits, scores and verdicts as dictionaries."""
    rng = random.Random(3)
    known = ["casino", "bets", "garden", "quiet", "river", "news", "poker", "straße", "月光", "maps", "tea"]
    made = ["".join(rng.choice("abcdeiorstu") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    rare = lambda: rng.choice(made + known)
    urls_ = [f"https://{rare()}{rng.choice(['-', '', '.'])}{rng.choice(known)}.org/{rare()}/{rare()}{rng.choice(['', '-7', '2x', '/12'])}" for _ in range(600)]
    urls_ += urls_[:50] + [None, "no scheme", "http://", "https://x.org", "https://pills.org/" + "quietgarden" * 30]
    df = spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string")

    def judged():
        return {r.page_id: r for r in urls.judge(df, URL_RULES).collect()}

    want = judged()
    for bound in (3, 320):  # both tables are larger; only that of the model is
        monkeypatch.setattr(urls, "MAX_WORDS", bound)
        kinds = urls.fit_segmenter(df.select(urls.host_of(df.url).alias("host"), urls.path_of(df.url).alias("path")))
        assert isinstance(kinds, urls.Segmenter) == (bound == 320)
        got = judged()
        assert set(got) == set(want)
        for i, w in want.items():
            g = got[i]
            assert (g.words, g.verdict, g.rule, g.host, g.path) == (w.words, w.verdict, w.rule, w.host, w.path), (g, w)
            assert abs(g.score - w.score) < 1e-9, (g, w)
