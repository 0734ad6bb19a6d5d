from paywire.llm import url_reputation as u
from paywire.llm.queries import URL_RULES


def test_rules_hosts_and_nulls(spark):
    urls = {1: "HTTP://A.Example.COM/en/71?x", 2: "x://com/en/", 3: "s://notcom/en/", 4: None, 5: "no scheme", 6: "s://b.example.net/de/8#f", 7: "s://y.net/de/", 8: "s://h?q://z", 9: "s://q.example.com/en/6", 10: "s://É.org/ES/"}
    pages = spark.createDataFrame([(k, v, 1) for k, v in urls.items()], "page_id long, url string, host int")
    labels = spark.createDataFrame([], "page_id long, bad int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in u.judge_urls(pages.drop("host"), labels, URL_RULES).collect()}
    assert got == {
        1: ("a.example.com", "/en/71", "example.com/en/7", "allow"),
        2: ("com", "/en/", "com/en/", "block"),
        3: ("notcom", "/en/", None, "allow"),
        4: ("", "", None, "allow"),
        5: ("", "", None, "allow"),
        6: ("b.example.net", "/de/8", "example.net/de/8", "block"),
        7: ("y.net", "/de/", "net/de/", "allow"),
        8: ("h", "", None, "allow"),
        9: ("q.example.com", "/en/6", "com/en/", "block"),
        10: ("É.org", "/ES/", None, "allow"),
    }
    assert u.judge_urls(pages.limit(0), labels, URL_RULES).count() == 0


def test_shrinkage(spark):
    rows = [(i, f"h://bad.a.com/{i}") for i in range(200)] + [(i, f"h://good.a.com/{i}") for i in range(200, 400)] + [(400, "h://new.a.com/"), (401, "h://one.b.com/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(400)] + [(401, 1), (401, None), (None, 1), (3, 0)], "page_id long, bad int")
    got = {r["page_id"]: r for r in u.judge_urls(pages, labels, []).collect()}
    assert got[0]["verdict"] == "block" and got[200]["verdict"] == "allow" and got[400]["verdict"] == "allow"
    assert 0.6 < got[0]["bad_mean"] < 0.76 and got[0]["bad_lower"] < got[0]["bad_mean"]
    assert 0 < got[401]["bad_mean"] < 1 and got[401]["n_labelled"] == 1


def judged(spark, outcomes, *asked):
    """Verdict of each asked host, from {host: (labelled pages, bad ones)}."""
    rows, labels = [], []
    for host, (n, bad) in outcomes.items():
        for i in range(n):
            labels.append((len(rows), int(i < bad)))
            rows.append((len(rows), f"h://{host}/{i}"))
    first = len(rows)
    rows += [(first + i, f"h://{host}/new") for i, host in enumerate(asked)]
    found = u.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int"), [])
    got = {r["page_id"]: r for r in found.collect()}
    return [got[first + i] for i in range(len(asked))]


def test_hosts_without_labels_take_their_domain(spark):
    outcomes = {f"w{i}.bad.com": (40, 40) for i in range(4)} | {f"w{i}.good{i}.com": (40, 0) for i in range(30)} | {f"x{i}.bad.zz": (40, 38) for i in range(3)}
    new, other, unknown, nowhere = judged(spark, outcomes, "new.bad.com", "new.good1.com", "new.fresh.com", "a.b.nowhere")
    assert new["verdict"] == "block" and new["n_labelled"] == 0 and new["bad_lower"] > 0.5
    assert [r["verdict"] for r in (other, unknown, nowhere)] == ["allow"] * 3
    assert other["bad_mean"] < 0.05 and unknown["bad_mean"] < 0.4


def test_ports_users_and_addresses(spark):
    outcomes = {"www.bad.com:8080": (60, 60), "10.0.0.1": (60, 60), "10.9.0.1": (60, 0)} | {f"w{i}.good{i}.com": (40, 0) for i in range(30)}
    port, user, dot, same, other = judged(spark, outcomes, "www.bad.com:443", "u:p@x.bad.com", "www.bad.com.", "10.0.0.1:81", "10.9.0.1:81")
    assert [r["verdict"] for r in (port, user, dot, same, other)] == ["block"] * 4 + ["allow"]
    hosts = spark.createDataFrame([(h,) for h in ("a.b.com.cn", "gov.uk", "x.gov.uk", "a.example.com", "10.0.0.1", "[::1]:8080", "", "com", "a.b.my.city")], "host string")
    how = u.Reputation(long_suffixes=("my.city",))
    got = {r["host"]: (r["domain"], r["suffix"]) for r in hosts.select("host", u.domain_of(hosts.host, how).alias("domain"), u.suffix_of(hosts.host, how).alias("suffix")).collect()}
    assert got == {
        "a.b.com.cn": ("b.com.cn", "com.cn"),
        "gov.uk": ("gov.uk", "gov.uk"),
        "x.gov.uk": ("x.gov.uk", "gov.uk"),
        "a.example.com": ("example.com", "com"),
        "10.0.0.1": ("10.0.0.1", "#"),
        "[::1]:8080": ("[::1]", "#"),
        "": ("", ""),
        "com": ("com", "com"),
        "a.b.my.city": ("b.my.city", "my.city"),
    }


def test_no_labels_long_urls_and_other_columns(spark):
    pages = spark.createDataFrame([(1, "h://a.com/" + "x" * 300_000, 1, 2), (1, "h://a.com/y", 1, 2), (None, None, 1, 2)], "page_id long, url string, domain int, bad int")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = u.judge_urls(pages, none, URL_RULES).collect()
    assert len(got) == 3 and {r["verdict"] for r in got} == {"allow"} and {r["n_labelled"] for r in got} == {0}
    assert sorted(len(r["path"]) for r in got) == [0, 2, 300_001]
