import re
from collections import Counter, defaultdict

from oddsmill.llm import line_dedup as L

SCHEMA = "page_id long, url string, html string, line string"


def brute(rows):
    pages = []
    for i, url, html, *_ in rows:
        text = re.sub(L.INLINE, "", re.sub(L.BLOCK, "\n", html or ""))
        m = re.match(L.HOST, url or "")
        pages.append((i, m[1].lower() if m else "", [x for x in (y.replace("\t", " ").strip(" ") for y in re.split("[\n\r]", text)) if x]))
    total, seen = Counter(h for _, h, _ in pages), defaultdict(Counter)
    for _, h, own in pages:
        seen[h].update(set(own))
    out = []
    for i, h, own in pages:
        stay = [x for x in own if not (total[h] >= L.LEAST_PAGES and seen[h][x] > 1 and seen[h][x] / total[h] > L.BOILERPLATE)]
        out.append((i, h, len(own), len(own) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r) for r in L.dedup_lines(df).collect()], key=str)


def test_odd_pages(spark):
    page = lambda k: f"<html><head><style>p{{a:b}}</style><script>x='</p>'</script></head><nav>Menu</nav><p>own {k}<br>twice</p><p>twice</p>\t<b>bo</b>ld<!-- <p>no</p> -->"
    rows = [(k, f"http://User@Host.example:80/{k}", page(k % 4), "clash") for k in range(12)]
    rows += [(100 + k, "https://small.example/x", page(k), "clash") for k in range(4)]
    rows += [(200, None, None, None), (None, "no host", "<p>a<p>a", None), (201, "http://e/", "", None), (1, "http://Host.example/again", page(1), "clash")]
    out = got(spark.createDataFrame(rows, SCHEMA))
    assert out == brute(rows)
    assert any(r[3] for r in out)
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_pages(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert got(df) == brute([(r.page_id, r.url, r.html) for r in df.collect()])


def test_small_hosts_follow_the_same_ratio(spark):
    page = lambda k: f"<nav>Menu</nav><p>own {k}</p><p>both</p>"
    rows = [(1, "http://two/a", page(1), ""), (2, "http://two/b", page(2), ""), (3, "http://one/a", page(3), "")]
    rows += [(10 + k, "http://four/x", f"<p>{'rare' if k < 1 else 'often'}</p><p>own {k}</p>", "") for k in range(4)]
    out = {r[0]: r[4] for r in got(spark.createDataFrame(rows, SCHEMA))}
    assert out[1] == "own 1" and out[2] == "own 2"
    assert out[3] == "Menu\nown 3\nboth"
    assert out[10] == "rare\nown 0" and out[11] == "own 1"


def test_markup_that_nothing_ends_is_read_in_one_pass(spark):
    rows = [(1, "http://a/", "<p>text</p>" + "<script " * 60_000, ""), (2, "http://b/", "one < two " * 30_000, ""), (3, "http://c/", "<!-- " * 60_000 + "x", "")]
    out = {r[0]: r for r in got(spark.createDataFrame(rows, SCHEMA))}
    assert out[1][4] == "text" and out[2][2] == 1 and out[3][4] == ""
