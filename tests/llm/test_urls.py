import random
import time

from foliospark.llm import queries, url_filter

HOSTS = ["bad.net", "a.example.net", "shop.example.com", "x.org", "free.info", "other.info", "more.info", "last.dev"]
PATHS = ["/en/1", "/de/2", "/fr/3", "/p", "/q/r", ""]


def plain_verdicts(pages, links):
    """Rules by loops, aliases by a plain union of all linked keys."""
    key = lambda u: (u.split("://", 1)[1].split("#")[0] if "/" in u.split("://", 1)[1] else u.split("://", 1)[1] + "/")

    def rule(k):
        host, path = k.split("/", 1)[0], "/" + k.split("/", 1)[1].split("?")[0] if "/" in k else ""
        found = [r for r in queries.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(found, key=lambda r: len(r.name)) if found else None

    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = root(key(a)), root(key(b))
        up[max(x, y)] = min(x, y)
    groups = {}
    for k in list(up):
        groups.setdefault(root(k), []).append(rule(k))
    out = {}
    for i, url in pages:
        own = rule(url.split("://", 1)[1])
        mates = [r.verdict for r in groups.get(root(key(url)), []) if r]
        out[i] = own.verdict if own else "allow" if "allow" in mates else "block" if "block" in mates else "allow"
    return out


def test_verdicts_spread_over_generated_graphs(spark):
    rng = random.Random(8)
    urls = [f"http://{rng.choice(['', 'www.', 'm.'])}{rng.choice(HOSTS)}{rng.choice(PATHS)}?n={n}" if rng.random() < 0.8 else f"https://{rng.choice(HOSTS)}/n{n}" for n in range(240)]
    urls = [u if "/" in u.split("://", 1)[1].split("?")[0] else u.replace("?", "/?") for u in urls]
    pages, links = [], []
    for n, url in enumerate(urls):
        html = "<html>"
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            to = rng.choice(urls)
            links.append((url, to))
            html += rng.choice(['<link rel="canonical" href="{}">', "<LINK href='{}' rel=canonical>", '<meta http-equiv="refresh" content="0; url={}">', '<meta content="3;URL={}" http-equiv=Refresh>']).format(to)
        pages.append((n, url, html))
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), queries.RULES).collect()}
    assert got == plain_verdicts([(n, u) for n, u, _ in pages], links)
    assert {"allow", "block"} == set(got.values())


def test_long_html_of_unclosed_links_is_read_in_linear_time(spark):
    html = "<link rel=x " * 200_000 + '<link rel="canonical" href="http://bad.net/1">'
    frame = spark.createDataFrame([(1, "http://a.info/1", html), (2, "http://b.info/1", "<link " * 200_000)], "page_id long, url string, html string")
    began = time.monotonic()
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(frame, queries.RULES).collect()}
    assert got == {1: "block", 2: "allow"} and time.monotonic() - began < 120
