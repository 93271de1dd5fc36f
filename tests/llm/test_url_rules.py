from panelloom.llm import url_rules as U

URLS = [
    "http://a.Example.NET/en/1?x#y",
    "https://example.net/en",
    "https://example.net",
    "http://xnet/",
    "http://b.example.com/de/5",
    "http://notexample.com/de/5",
    "https://q.org/fr/1",
    "https://spam-farm.example.org/en/1",
    "http://www.cheap-pills.example.com/en/2",
    "no url at all",
    None,
    "",
    "x://?q",
    "http://h.net#f/://x",
    "HTTP://A.NET/",
    "http://ok.com/redirect?adurl=1",
    "http://" + "a" * 50000 + ".net/",
    "http://a\nb.net/",
    "http://a\n.b\n/net/",
    "http://example.com/de\n/x",
    "http://casino\n.com/",
]


def brute(url):
    host, path = U.split_url(url)
    best = None
    for r in U.HOST_RULES:
        h, _, p = r.name.partition("/")
        if host and (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r.name) > len(best.name)):
            best = r
    low = (url or "").lower()
    plain = "block" if any(U.re.search(r.regex, low) for r in U.PATTERN_RULES) else "allow"
    return host, path, best.name if best else None, best.verdict if best else plain


def test_matches_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "", "") for i, u in enumerate(URLS)] + [(3, URLS[3], "", "")], "page_id long, url string, host string, rule string")
    rows = U.judge_urls(pages).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        assert tuple(r)[1:] == brute(URLS[r["page_id"]])
    assert {r["verdict"] for r in rows if r["page_id"] in (7, 8, 15)} == {"block"}


def test_rarest_token_files_each_rule():
    index = U.Index(U.HOST_RULES, {"example": 900, "net": 500, "com": 400, "org": 10, "en": 950, "de": 950, "fr": 950})
    assert {t: len(k) for t, k in index.filed.items()} == {"net": 2, "com": 1, "org": 1}


def test_derived_tokens_are_whole_runs():
    want = {
        r"://(?:[^/?#]*\.)?spam-farm\.": ("farm", "spam"), r"://(?:[^/?#]*[.-])?casino[.-]": ("casino",), r"[?&]adurl=": ("adurl",),
        r"://(?:[^/?#]*\.)?ads?\.doubleclick\.": ("doubleclick",), r"casino": (), r"/casino": (), r"/(?:buy|sell)/now/": ("now",), r"(?i)/ad/": (),
        r"/a+/x1/": ("x1",), r"/x(?:-y-)?z/": (), r"(?:/promo/)+z": ("promo",), r".ad/": (), r"\A/ad/\Z": ("ad",),
    }
    assert {r: U.literal_tokens(r) for r in want} == want


def test_thousands_of_rules_give_what_trying_all_gives(spark):
    hosts = tuple(U.host_rule(f"h{k % 700}.{'net' if k % 3 else 'com'}/{'p' * (k % 4)}{k % 5}{'/' * (k % 2)}", "block" if k % 2 else "allow") for k in range(2500))
    patterns = tuple(U.pattern_rule(rf"/word{k}(?:-[a-z]+)?/|[?&]key{k}=" if k % 4 else rf"[/.]only{k}[/.]") for k in range(1500))
    rules = hosts + patterns
    urls = [f"http://{'s.' * (k % 3)}h{k * 7 % 900}.{('net', 'com', 'org')[k % 3]}/{'p' * (k % 4)}{k % 6}/word{k}/only{4 * k}/?key{k}={k}" for k in range(400)]
    whole = U.Index(tuple(U.Rule(r.name, r.verdict, r.regex, (), r.length) for r in rules), {})
    assert len(whole.always) == len(rules)
    got = U.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    assert {r["page_id"]: tuple(r)[1:] for r in got} == {k: whole.judge(u) for k, u in enumerate(urls)}
    index = U.Index(rules, {})
    assert len(index.always) < 1200 and {r["verdict"] for r in got} == {"allow", "block"}


def test_query_and_sql_agree_on_line_feeds(spark):
    import duckdb

    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    want = {r[0]: r[1:] for r in con.sql(U.OP8_SQL).fetchall()}
    assert {r["page_id"]: tuple(r)[1:] for r in U.judge_urls(pages).collect()} == want


def test_empty(spark):
    assert U.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
