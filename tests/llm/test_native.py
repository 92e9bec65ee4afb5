"""Chat formatting and URL verdicts against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from contentdup.llm.chat import format_chats
from contentdup.llm.queries import URL_RULES
from contentdup.llm.url_trees import BINS, FEATURES, RATES, best_split, binned, judge_urls, train_url_model
from tests.llm.cases import rows_of

PYTHON_NODES = ("Python", "Pandas", "Arrow")


def chats(spark, rows):
    made = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    return made.withColumns({c: F.lit(c) for c in ("pos", "piece", "n", "part")})


def wanted_chats(rows, per_part):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    out = []
    for c, own in turns.items():
        if any(b != c and o[: len(own)] == own and (len(o) > len(own) or b < c) for b, o in turns.items()):
            continue
        for part in range(-(-len(own) // per_part)):
            shown = "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in own[part * per_part : (part + 1) * per_part])
            out.append((c, part, len(own), shown))
    return sorted(out, key=repr)


def test_chats(spark):
    source = random.Random(2)
    base = [[(source.choice("ab"), source.choice("xyz")) for _ in range(12)] for _ in range(3)]
    rows = []
    for conv in range(60):
        for turn, (role, text) in enumerate(source.choice(base)[: source.randint(1, 12)]):
            rows.append((conv, turn, role, text))
    rows += [(100, t, "user", str(t)) for t in range(500)] + [(101, t, "user", str(t)) for t in range(499)]
    rows += [(102, None, None, None), (103, 0, "", ""), (104, 0, "a", "x"), (104, 0, "a", "x"), (None, 0, "a", "x")]
    got = format_chats(chats(spark, rows), turns_per_part=7)
    assert rows_of(got, "conv_id", "part", "n_turns", "rendered") == wanted_chats(rows, 7)


def test_no_chats(spark):
    assert format_chats(chats(spark, [(1, 1, "a", "b")]).where("false")).count() == 0


def wanted_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [
        r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


URLS = [
    "http://a.example.net/en/1?x=1#y", "https://EXAMPLE.net/en", "http://example.net/en/", "http://xexample.net/en/", "http://a.net",
    "http://a.net/", "https://x.example.com/de/1", "http://example.com/den", "http://b.org/fr/?q=http://c.net/", "//c.net/", "c.net/x",
    "", None, "http://", "http:///x", "http://a.org?/fr/", "ftp://net/", "http://net/x", "x://Ä.NET/", "http://a\nb.net/\n?", "http://" + "a." * 20000 + "net/",
]


def pages(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumns(
        {c: F.lit(c) for c in ("host", "depth", "rule", "p_block", "shown")}
    )


def test_url_rules(spark):
    got = judge_urls(pages(spark, URLS), URL_RULES)
    wanted = [(i, *wanted_rule(url)) for i, url in enumerate(URLS)]
    found = {row.page_id: row for row in got.collect()}
    assert [(i, found[i].host, found[i].path, found[i].rule) for i in range(len(URLS))] == [w[:4] for w in wanted]
    assert all(found[i].verdict == verdict for i, *_, verdict in wanted if verdict)
    assert {row.verdict for row in found.values()} <= {"allow", "block"}
    assert not any(node in got._jdf.queryExecution().toString() for node in PYTHON_NODES)


def test_trees_learn(spark):
    source = random.Random(6)
    rows = []
    for i in range(600):
        bad = source.random() < 0.4
        host = ("casino-" if bad else "") + source.choice(["alpha", "beta", "gamma"]) + source.choice([".com", ".org"])
        rows.append((f"http://{host}/{'9' * 8 if bad else 'page'}/{i}", int(bad)))
    labelled = spark.createDataFrame(rows, "url string, blocked int")
    judged = judge_urls(pages(spark, [u for u, _ in rows]), [], labelled).orderBy("page_id").collect()
    assert sum((r.verdict == "block") == bool(y) for r, (_, y) in zip(judged, rows)) >= 590
    assert len(train_url_model(labelled, n_trees=2).trees) == 2


@pytest.mark.parametrize("blocked", [[], [0, 0], [1]])
def test_trees_without_two_classes(spark, blocked):
    labelled = spark.createDataFrame([("http://a.b/", b) for b in blocked], "url string, blocked int")
    verdicts = {r.verdict for r in judge_urls(pages(spark, ["http://c.d/", None]), [], labelled).collect()}
    assert verdicts == {"allow"} if blocked == [0, 0] else verdicts <= {"allow", "block"}


def test_no_pages(spark):
    assert judge_urls(pages(spark, URLS).where("false"), URL_RULES).count() == 0


def labelled_urls(spark, numbers):
    """URLs whose label follows from lexical features, none of them a host."""
    source = random.Random(9)
    rows = []
    for i in numbers:
        bad = source.random() < 0.4
        host = source.choice(["www.", ""]) + "".join(source.choices("abcdefgh", k=9)) + source.choice([".com", ".org", ".info"])
        path = "/".join("".join(source.choices("0123456789" if bad else "lmnopqrst", k=6)) for _ in range(source.randint(1, 4)))
        rows.append((i, f"http://{host}/{path}" + ("?a=1&b=2&c=3" if bad and i % 5 else ""), int(bad)))
    return spark.createDataFrame(rows, "page_id bigint, url string, blocked int")


def test_trees_judge_urls_they_have_not_seen(spark):
    rows = labelled_urls(spark, range(1500))
    seen, unseen = rows.where("page_id % 3 > 0"), rows.where("page_id % 3 = 0")
    judged = judge_urls(unseen.select("page_id", "url"), [], seen).join(unseen.select("page_id", "blocked"), "page_id").collect()
    assert sum((r.verdict == "block") == bool(r.blocked) for r in judged) >= 0.95 * len(judged)
    assert len({r.p_block for r in judged}) >= 10
    gains = train_url_model(seen).gains()
    assert sum(gains[f] for f in FEATURES if f not in RATES) > sum(gains[f] for f in RATES)


def test_shares_leave_out_the_own_label(spark):
    """Labels by chance cannot be learnt from shares of URLs of their own."""
    source = random.Random(4)
    rows = [(f"http://{''.join(source.choices('abcdefgh', k=12))}.zz/x", source.randint(0, 1)) for _ in range(400)]
    gains = train_url_model(spark.createDataFrame(rows, "url string, blocked int"), n_trees=4).gains()
    assert gains["domain_rate"] < 0.1 * len(rows)


def test_best_split_equals_brute_force():
    source = random.Random(8)
    for _ in range(50):
        rows = [([source.randrange(BINS) for _ in range(3)], source.uniform(-1, 1), source.uniform(0.1, 1)) for _ in range(30)]
        sums = {}
        for bins, g, h in rows:
            for f, b in enumerate(bins):
                old = sums.get((f, b), (0.0, 0.0))
                sums[f, b] = (old[0] + g, old[1] + h)

        def value(part, ridge=1.0):
            return sum(g for _, g, _ in part) ** 2 / (sum(h for *_, h in part) + ridge)

        best = max(
            (value(left) + value(right) - value(rows), -f, -upto)
            for f in (0, 2)
            for upto in range(BINS - 1)
            for left, right in [([r for r in rows if r[0][f] <= upto], [r for r in rows if r[0][f] > upto])]
            if left and right
        )
        gain, feature, upto = best_split(sums, [0, 2], 1.0)
        assert abs(gain - best[0]) < 1e-6 and (feature, upto) == (-best[1], -best[2])


def test_bins_by_edges(spark):
    got = spark.range(10).select(binned(F.col("id"), [2.0, 2.5, 7.0]).alias("b"), binned(F.col("id"), []).alias("z")).collect()
    assert [r.b for r in got] == [0, 0, 0, 2, 2, 2, 2, 2, 3, 3] and {r.z for r in got} == {0}
