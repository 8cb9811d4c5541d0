"""Each operator against a plain version, and its edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import gzip
import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparklake.llm import chat_format, decontaminate, language_id, mixing, quality_rules, queries, simhash_dedup, substring_dedup, token_count, url_filter, warc
from sparklake.session import scratch_path
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = [f"w{i}" for i in range(40)]


def passages(seed, n, size):
    r = random.Random(seed)
    return [" ".join(r.choices(VOCAB, k=size)) for _ in range(n)]


def odd_rows():
    long = " ".join(passages(9, 400, 60))
    return [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \t\n ", "en", None, 4),
        (4, "one", "en", "a", 3),
        (5, long, "en", "b", len(long)),
        (6, "word\xa0joined été 123 !?", "fr", "b", 20),
        (7, "word\xa0joined été 123 !?", "fr", "b", 20),
    ]


def docs(spark, rows, extra=True):
    df = spark.createDataFrame(rows, DOCS)
    # names that operators could clash with
    return df.withColumns({c: F.lit(1) for c in ("k", "pos", "id", "fp", "size", "_w", "count", "row")}) if extra else df


@pytest.fixture(scope="module")
def copied():
    r = random.Random(3)
    shared = passages(1, 6, 45)
    rows = []
    for i in range(120):
        parts = passages(100 + i, 3, r.randint(5, 60))
        if i % 3 == 0:
            parts.insert(r.randint(0, 3), r.choice(shared))
        if i % 5 == 0:
            parts = parts + parts[:1]
        rows.append((i * 7 % 120, "\n".join(parts), "en", f"s{i % 4}", 0))
    rows += [(200 + i, rows[3][1], "en", "s0", 0) for i in range(30)]
    return rows


def test_substring_dedup_is_exact(spark, copied):
    rows = copied + [(500 + r[0], *r[1:]) for r in odd_rows()]
    for buckets in (1, 7):
        found = substring_dedup.dedup_substrings(docs(spark, rows), buckets=buckets)
        got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256((r.kept or "").encode()).hexdigest()) for r in found.collect()}
        assert got == brute.substring_dedup([(r[0], r[1]) for r in rows])


def test_substring_dedup_small_flushes(spark, copied):
    found = substring_dedup.dedup_substrings(docs(spark, copied).repartition(13), window=25, flush=300)
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256((r.kept or "").encode()).hexdigest()) for r in found.collect()}
    assert got == brute.substring_dedup([(r[0], r[1]) for r in copied], 25)


def test_substring_dedup_repeated_rows_and_null_ids(spark):
    text = passages(5, 1, 50)[0]
    rows = [(1, text), (1, text), (2, text), (None, text)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in substring_dedup.dedup_substrings(df, keep=("lang", "source"), normalise=False).collect()))
    # the null id comes first, so it keeps its words; equal rows don't flag each other but the null row flags both
    assert got == [(False, 1, 50), (False, 1, 50), (False, 2, 50), (True, 0, 0)]
    assert substring_dedup.dedup_substrings(df.limit(0)).collect() == []


def test_substring_dedup_of_rows_that_share_an_id(spark):
    a, b, c = passages(6, 3, 30)
    # every text without an id, or with an id that others have, is a document of its own
    rows = [(None, a + " " + b), (None, c + " " + a), (None, c), (7, b + " " + c), (7, passages(8, 1, 60)[0]), (7, passages(8, 1, 60)[0])]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    got = {r.text: r.n_removed for r in substring_dedup.dedup_substrings(df, keep=("text",)).collect()}
    total = sum(got.values())
    assert got[rows[3][1]] == 60 and got[rows[4][1]] == 0
    assert total - 60 == 60  # a and c each stay once among the rows without an id
    with pytest.raises(ValueError, match="clashes"):
        substring_dedup.dedup_substrings(df.withColumn("kept", F.lit(1)), keep=("kept",))


def test_substring_dedup_of_structured_words(spark):
    # words and runs of words on which polynomial hashes modulo 2**64 collide
    even = "a"
    for _ in range(10):
        even += even.translate(str.maketrans("ab", "ba"))
    odd = even.translate(str.maketrans("ab", "ba"))
    around = [f"x{i}" for i in range(19)]
    rows = [(0, " ".join([even, *around])), (1, " ".join([odd, *around])), (2, " ".join(even[:1024])), (3, " ".join(odd[:1024]))]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substring_dedup.dedup_substrings(df).collect()}
    assert got == brute.substring_dedup(rows) and got[1][1] == 0


def test_cover_holds_every_difference():
    diffs = {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER}
    assert diffs == set(range(substring_dedup.PERIOD))


@pytest.mark.parametrize("payload", [b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody\n\nmore", b"plain text", b"", b"URL 1.1.1.1 20200101000000 text/html 5\nhello"])
@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("zipped", [False, True])
def test_arc_round_trip(payload, version, zipped):
    raw = warc.build_arc("x.arc", version, [("http://a.b/c d", "1.2.3.4", "19990102030405", "text/html", payload), ("dns:a.b", "1.2.3.4", "1999", "text/dns", b"z")])
    first, record, last = warc.parse_arc(gzip.compress(raw) if zipped else raw)
    assert (first.warc_type, record.version, record.url, record.block, record.date) == ("warcinfo", version, "http://a.b/c d", payload, "1999-01-02T03:04:05Z")
    assert record.warc_type == ("response" if payload.startswith(b"HTTP") else "resource")
    assert record.parts()[1] == (b"body\n\nmore" if payload.startswith(b"HTTP") else payload)
    assert (last.warc_type, last.date) == ("response", "1999-01-01T00:00:00Z")


def test_arc_rejects_truncation():
    raw = warc.build_arc("x.arc", 1, [("http://a/", "1.2.3.4", "19990102030405", "text/html", b"abc")])
    with pytest.raises(ValueError, match="declares"):
        list(warc.parse_arc(raw[:-3]))


def test_arc_conversion_keeps_types_addresses_and_version_blocks(spark, tmp_path):
    dns, http = b"20200101\na.b. 300 IN A 1.2.3.4\n", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n" + b"\x00\xff body" * 300
    records = [("dns:a.b", "9.9.9.9", "20200101000000", "text/dns", dns), ("http://a.b/", "1.2.3.4", "20200101000001", "image/gif", http), ("ftp://a.b/x", "1.2.3.5", "20200101000002", "image/png", b"png"), ("ftp://a.b/y", "-", "2020", "no-type", b"")]
    df = spark.createDataFrame([(f"x{v}.arc", gzip.compress(warc.build_arc(f"x{v}.arc", v, records))) for v in (1, 2)] + [("none", None), ("empty", b"")], "name string, content binary")
    warc.write_warc(warc.mark_revisits(warc.convert_arc(df)), str(tmp_path / "w"))
    got = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert Counter(r.record_type for r in got) == {"warcinfo": 2, "response": 4, "resource": 4}
    assert {(r.url, r.content_type, r.ip) for r in got if r.url} == {("dns:a.b", "text/dns", "9.9.9.9"), ("http://a.b/", "application/http; msgtype=response", "1.2.3.4"), ("ftp://a.b/x", "image/png", "1.2.3.5"), ("ftp://a.b/y", "application/octet-stream", None)}
    infos = {r.record_id: bytes(r.payload) for r in got if r.record_type == "warcinfo"}
    assert {r.warcinfo_id for r in got if r.record_type != "warcinfo"} == set(infos) and all(b"isPartOf: x" in x and b"URL IP-address" in x for x in infos.values())
    assert [bytes(r.payload) for r in got if r.url == "http://a.b/"] == [b"\x00\xff body" * 300] * 2
    # every record is a gzip member of its own, also to a reader of plain gzip
    for f in (tmp_path / "w").glob("part-*"):
        raw = f.read_bytes()
        parts = list(warc.members(raw))
        assert all(p.startswith(b"WARC/1.1\r\n") and p.count(b"WARC-Record-ID") == 1 for p in parts) and gzip.decompress(raw) == b"".join(parts)


def test_gzip_members():
    for data in (b"", b"x", b"\0" * 70000, bytes(range(256)) * 300):
        assert list(warc.members(warc.member(data) + b"\0" + warc.member(b"next") + b"\0")) == [data, b"next"]
    with pytest.raises(ValueError, match="cut off"):
        list(warc.members(warc.member(b"x" * 100)[:20]))


def test_warc_of_pages(spark):
    big, other = "é\r\n\r\nWARC/1.1\r\n" * 100, "y" * 1000
    rows = [(1, "http://a", big), (2, "http://b", big), (9, None, big), (3, "http://c", other), (4, "http://d", "z" * 999), (5, "http://e", "z" * 999), (6, "http://f", None), (None, "http://g", big), (7, "http://h\nx", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("row", F.lit(0))
    got = warc.archive_pages(pages, scratch_path(spark, "t")).collect()
    assert len(got) == len(rows)
    by = {r.row: r for r in got}
    assert {k: (r.record_type, r.refers_to_row) for k, r in by.items()} == {1: ("revisit", 9), 2: ("revisit", 9), None: ("revisit", 9), 9: ("response", None), **{k: ("response", None) for k in (3, 4, 5, 6, 7)}}
    for page_id, _, html in rows:
        data = (html or "").encode()
        assert (by[page_id].payload_bytes, by[page_id].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    assert by[1].refers_to == by[9].record_id
    assert warc.archive_pages(pages.limit(0), scratch_path(spark, "t")).collect() == []


@pytest.fixture(scope="module")
def speech():
    r = random.Random(1)
    stock = {"aa": "the of and house river green", "bb": "und der schön straße über", "cc": "été où garçon être là"}
    rows = []
    for i in range(300):
        lang = list(stock)[i % 3]
        rows.append((i, " ".join(r.choices(stock[lang].split(), k=r.randint(4, 80))), lang, "s", 0))
    return stock, rows


def test_language_of_mixtures(spark, speech):
    stock, rows = speech
    model = language_id.fit(docs(spark, rows))
    assert model.langs == ["aa", "bb", "cc"]
    r = random.Random(2)
    both = " ".join(r.choices(stock["aa"].split(), k=60) + r.choices(stock["bb"].split(), k=30))
    df = docs(spark, rows + [(1000, both, None, None, 0)])
    got = {x.doc_id: x for x in language_id.identify(df, model, keep=("lang",)).collect()}
    assert sum(got[r[0]].lang_pred == r[2] for r in rows) >= 297
    assert got[1000].lang_pred == "aa" and set(got[1000].mixture) == {"aa", "bb"}
    assert abs(got[1000].mixture["bb"] - 1 / 3) < 0.08


def test_language_edges(spark, speech):
    model = language_id.fit(docs(spark, speech[1]))
    got = {x.doc_id: x for x in language_id.identify(docs(spark, odd_rows() + [(8, "12 34 -- !", None, None, 0)]), model).collect()}
    assert {k for k, x in got.items() if x.lang_pred == "und"} == {1, 2, 3, 8}
    assert all(0 <= x.score <= 1 for x in got.values()) and all(got[k].score == 0 for k in (1, 2, 3, 8))
    assert got[6].lang_pred == got[7].lang_pred
    none = language_id.fit(docs(spark, odd_rows()).limit(0))
    assert {x.lang_pred for x in language_id.identify(docs(spark, odd_rows()), none).collect()} == {"und"}
    one = language_id.Model.fit([("aa", "the house")])
    assert {x.lang_pred for x in language_id.identify(docs(spark, odd_rows()[3:]), one).collect()} == {"aa"}


def brute_contamination(rows, bench):
    split = lambda t: re.findall(r"(?:[^\W_]|[^\x00-\x7f])+", (t or "").lower())
    bags = {}
    for item, text in bench:
        w = split(text)
        if len(w) >= decontaminate.MIN_WORDS:
            bags[item] = (len(w), Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)))
    found = {}
    for doc, text in rows:
        w = split(text)
        for item, (m, bag) in bags.items():
            for s in range(len(w) - m + 1):
                own = Counter(tuple(w[i : i + 5]) for i in range(s, s + m - 4))
                like = sum((own & bag).values()) / sum((own | bag).values())
                if like >= 0.8:
                    found[doc, item] = max(like, found.get((doc, item), 0))
    return found


def test_contamination_is_found(spark):
    r = random.Random(4)
    items = [(i, p) for i, p in enumerate(passages(50, 12, 40))] + [(50, None), (51, ""), (52, "w1 w2 w3"), (53, "w1 w2 w3 w4 w5 w6 w7 w8")]
    rows = []
    for i in range(60):
        text = passages(700 + i, 1, 90)[0].split()
        if i % 3:
            leak = items[i % 12][1].split()
            if i % 3 == 2:
                leak[-1 - i % 3] = "changed"
            at = r.randint(0, 90)
            text[at:at] = leak
        sep = "\n" if i % 2 else " "
        rows.append((i, sep.join(text).upper() + ".", "en", "s", 0))
    rows += [(900 + r[0], *r[1:]) for r in odd_rows()]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("id", F.lit(1))
    df = docs(spark, rows)
    got = {(x.doc_id, x.item_id): x.similarity for x in decontaminate.contaminated(df, bench).collect()}
    want = brute_contamination([(x[0], x[1]) for x in rows], items)
    assert len(want) >= 40 and got == pytest.approx(want)
    kept = {x.doc_id for x in decontaminate.clean(df, bench).collect()}
    assert kept == {x[0] for x in rows} - {d for d, _ in want}
    assert decontaminate.contaminated(df, bench.limit(0)).collect() == []
    assert decontaminate.contaminated(df.limit(0), bench).collect() == []


def test_contamination_in_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 400)
    items = list(enumerate(passages(51, 8, 30)))
    rows = [(i, text, "en", "s", 0) for i, text in items]
    got = decontaminate.contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((x.doc_id, x.item_id) for x in got) == [(i, i) for i in range(8)]


def test_multi_index_finds_all_within_radius():
    items = decontaminate.Items(list(enumerate(passages(60, 5, 30))))
    r = random.Random(5)
    for item, fp in enumerate(items.prints.tolist()):
        for n in (0, 1, 8, 15):
            other = fp
            for b in r.sample(range(64), n):
                other ^= 1 << b
            found = {i: far.tolist() for _, i, far in items.within(decontaminate.np.array([other], "uint64"), 30)}
            assert found[item] == [n]


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Water filling by repeated sharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free, left = {}, list(order), float(sum(sizes.values()))
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * unit > cap * sizes[s]]
        if not full:
            return out | {s: weight[s] * unit for s in free}
        for s in full:
            out[s] = float(cap * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in full]
    return out


def test_mixing_meets_targets(spark):
    r = random.Random(6)
    rows = [(i, passages(i, 1, r.randint(1, 120))[0] if i % 50 else None, "en", r.choice(["a", "B", "c", "é", None, "a", "a"]), 0) for i in range(2000)]
    rows += [(5000, passages(1, 1, 5)[0], "en", "0tiny", 0), (5001, "", "en", "1empty", 0), (5002, " ", "en", "1empty", 0)]
    df = docs(spark, rows)
    once = mixing.mix(df.drop("size"), keep=("source",)).collect()
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(brute.words(text))
    want = targets(sizes)
    taken = Counter()
    for x in once:
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(want[x.source])
        assert x.taken == x["size"] * len(x.shards) or x["size"] == 0
        assert 0 <= x.taken <= 3 * x["size"]
        taken[x.source] += x.taken
    assert want["0tiny"] == 15 and len(once) == len(rows)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.01 * t, 10), (s, taken[s], t)
    again = mixing.mix(df.drop("size").repartition(7), keep=("source",)).collect()
    assert sorted(map(str, once)) == sorted(map(str, again))
    assert mixing.mix(df.limit(0)).collect() == []


def test_mixing_shards_share_each_source(spark):
    rows = [(i, "a b c d", "en", f"s{i % 3}", 0) for i in range(6000)]
    mixed = mixing.mix(docs(spark, rows, extra=False), keep=("source",))
    drawn = mixing.draw(mixed)
    units = Counter((x.source, x.shard) for x in drawn.collect())
    assert sum(units.values()) * 4 == sum(x.taken for x in mixed.collect())
    total = Counter()
    for (s, _), n in units.items():
        total[s] += n
    for (s, _), n in units.items():  # about an eighth each
        assert 0.5 < 8 * n / total[s] < 1.6


def plain_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def brute_url(url, rules):
    host, path = plain_host_path(url)
    best = None
    for action, rule in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, action)
    return (host, path, *(best or (None, "allow")))


def odd_urls():
    hosts = ["example.com", "www.example.com", "a.www.example.com", "EXAMPLE.com", "badexample.com", "x.net", "net", "com", "", "ex-ample.com", "example.com:80", "İ.É.NET", "a\nb.net"]
    paths = ["", "/", "/en/", "/en", "/EN/x", "/es/1", "/fr/?q", "?/en/", "#/en/", "/en/?a#b", "/a/en/", "/es/\n?", "/en/" + "x" * 20000]
    return [s + h + p for s in ("http://", "https://", "") for h in hosts for p in paths] + [None, "", "://", "://net/es/x", "a://b://net/es/"]


def test_url_rules(spark):
    urls = odd_urls()
    random.Random(7).shuffle(urls)
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("best", F.lit(7))
    rules = [url_filter.prefix_rule(*x) for x in queries.URL_RULES]
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_filter.judge(rows, rules).collect()}
    assert got == {k: brute_url(u, queries.URL_RULES) for k, u in enumerate(urls)}
    assert url_filter.judge(rows.limit(0), rules).collect() == []
    assert {x.verdict for x in url_filter.judge(rows, []).collect()} == {"allow"}


def test_url_rules_by_rarest_token_and_in_passes(spark, monkeypatch):
    rules = [url_filter.prefix_rule("block", f"host{i}.com/p{i}/") for i in range(40)] + [url_filter.pattern_rule("block", r"\d{9}")]
    by_token, always = url_filter.index(rules, {"com": 1000, **{f"host{i}": 5 for i in range(40)}})
    assert "com" not in by_token and by_token["p3"] == [3] and always == [40]
    rows = spark.createDataFrame([(i, f"http://www.host{i}.com/p{i}/x") for i in range(41)] + [(99, "http://z/123456789")], "page_id long, url string")
    plain = {x.page_id: (x.rule, x.candidates) for x in url_filter.judge(rows, rules).collect()}
    monkeypatch.setattr(url_filter, "PASS_RULES", 7)
    assert plain == {x.page_id: (x.rule, x.candidates) for x in url_filter.judge(rows, rules).collect()}
    assert plain[5] == ("host5.com/p5/", 1) and plain[40] == (None, 1) and plain[99] == (r"\d{9}", 1)


PATTERNS = [r"/ads?/", r"\bspam-(?:farm|hut)\b", r"\A(?:[^/]*\.)?x1\.net/", "a.b", r"(/p/)q\Z", r"/a|b/", r"(?:/c/)?d/", r"/e+/", r"(?i)/En/", r"/f(?=/g)", r"/h\b", r"[/.]i[-/]", r"\.j_k/", r"/l/\S*/m/", "", r"/[0-9]/n\.", r"É/o/", r"/(?i:P)/"]


def test_url_patterns_by_their_literals(spark):
    r = random.Random(17)
    parts = ["ad", "ads", "spam", "farm", "spam-farm", "spam-hut", "x1.net", "y.x1.net", "a", "b", "p", "q", "c", "d", "e", "ee", "En", "f", "g", "h", "i", "j_k", "l", "m", "7", "n.", "É", "o", "P", "_", "-"]
    urls = [f"http://{r.choice(parts)}/" + r.choice(["/", "."]).join(r.choices(parts, k=r.randint(0, 6))) + r.choice(["", "/"]) for _ in range(1500)]
    rules = [url_filter.pattern_rule("block" if i % 2 else "allow", p, i % 3) for i, p in enumerate(PATTERNS)]
    want = {}
    for k, url in enumerate(urls):
        text = "".join(plain_host_path(url))
        found = [x for x in rules if re.search(x.pattern, text)]
        assert all(set(x.literals) <= url_filter.tokens(text) for x in found)
        win = min(found, key=lambda x: (-x.priority, -len(x.name), rules.index(x)), default=None)
        want[k] = (win.name, win.action) if win else (None, "block")
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = url_filter.judge(rows, rules, default="block").collect()
    assert {x.page_id: (x.rule, x.verdict) for x in found} == want
    assert sum(x.candidates for x in found) < 0.7 * len(urls) * len(rules)
    assert [x.literals for x in rules[:6]] == [(), ("spam",), ("net",), (), ("p", "q"), ()] and rules[11].literals == ("i",)


def test_preferences(spark):
    turn = lambda role, text: {"role": role, "text": text}
    a = [turn("system", "s"), turn("user", "q"), turn("assistant", "good"), turn("user", "more"), turn("assistant", "é!")]
    b = a[:2] + [turn("assistant", "bad")]
    pairs = spark.createDataFrame([(1, a, b), (2, a, a), (3, a, None), (4, [], []), (5, b, a[:2])], f"id int, chosen {chat_format.TURNS}, rejected {chat_format.TURNS}").withColumn("prompt_x", F.lit(1))
    got = {x.id: x for x in chat_format.format_preferences(pairs).collect()}
    assert [got[i].prompt_turns for i in range(1, 6)] == [2, 5, 0, 0, 2]
    assert got[1].prompt == "<|turn|>system\ns<|end|>\n<|turn|>user\nq<|end|>\n"
    assert [got[1].chosen_text[s.start : s.end] for s in got[1].chosen_spans] == ["good<|end|>\n", "é!<|end|>\n"]
    assert [got[1].rejected_text[s.start : s.end] for s in got[1].rejected_spans] == ["bad<|end|>\n"]
    assert got[2].chosen_text == got[2].rejected_text == "" and got[2].chosen_spans == []
    assert got[3].prompt == "" and got[3].rejected_text == "" and len(got[3].chosen_spans) == 2
    assert got[5].rejected_text == "" and got[5].rejected_spans == []


def test_contrast_pairs(spark):
    rows = [(2, 0, "user", "q"), (2, 1, "assistant", "x"), (2, 2, "user", "bye"), (3, 1, "assistant", "y"), (3, 0, "user", None), (5, 0, "assistant", "z"), (6, 0, "user", "q"), (None, 0, "assistant", "n"), (None, 1, "user", "m"), (8, None, None, "t"), (8, 1, "assistant", "u")]
    rows += [(9, k, "assistant" if k % 2 else "user", "same" if k < 4 else f"own{k}") for k in range(8)]
    convs = chat_format.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("prompt", F.lit(1)))
    found = chat_format.format_preferences(chat_format.contrast_pairs(convs)).collect()
    got = {x.conv_id: x for x in found if x.conv_id is not None}
    assert set(got) == {2, 3, 5, 6, 8, 9} and len(found) == 8
    # what follows the answer in contrast stays on both sides
    assert got[2].prompt_turns == 1 and "x" in got[2].chosen_text and "y" in got[2].rejected_text and got[2].rejected_text.endswith("bye<|end|>\n")
    assert got[3].prompt == "<|turn|>user\n<|end|>\n" and "x" in got[3].rejected_text
    assert got[5].rejected_text == "" and got[5].prompt == ""
    assert got[6].prompt_turns == 1 and got[6].chosen_text == got[6].rejected_text == ""
    # 9 % 4: its second answer, against the only one of 8; three turns are common
    assert got[9].prompt_turns == 3 and len(got[9].chosen_spans) == 3 and "\nu<|end|>" in got[9].rejected_text
    assert sorted((x.prompt, x.chosen_text, x.rejected_text) for x in found if x.conv_id is None) == [("", "<|turn|>assistant\nn<|end|>\n", ""), ("<|turn|>user\nm<|end|>\n", "", "")]
    with pytest.raises(ValueError, match="name of the result"):
        chat_format.format_preferences(chat_format.contrast_pairs(convs).withColumn("prompt", F.lit(1)))
    assert chat_format.format_preferences(chat_format.contrast_pairs(convs.limit(0))).collect() == []


def test_rendered_texts_tell_their_turns(spark):
    texts = ["a<|end|>\n<|turn|>assistant\nb", "<|turn|>", "<\\|end|>", "<\\\\|", "", "é<|"]
    turns = [("user" if i % 2 else "assis<|tant", t) for i, t in enumerate(texts)] + [("assistant", texts[0])]
    df = spark.createDataFrame([(turns, [])], "chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    got = chat_format.format_preferences(df).first()
    parts = [p.split("\n", 1) for p in got.chosen_text.split("<|turn|>")[1:]]
    plain = lambda x: re.sub(r"<\\(\\*)\|", r"<\1|", x)
    assert [(plain(role), plain(text.removesuffix("<|end|>\n"))) for role, text in parts] == turns
    assert [plain(got.chosen_text[x.start : x.end]) for x in got.chosen_spans] == [texts[0] + "<|end|>\n"]


def brute_stats(text):
    w = brute.words(text)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    at = {i + j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if brute.words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(at)


def test_quality_statistics(spark):
    r = random.Random(8)
    rows = [(100 + i, "\n".join(r.choice(["a b", "c |d", "", " ", "e $ f g", "a b c a b c"]) for _ in range(r.randint(0, 30))), "en", "s", 0) for i in range(80)]
    rows += odd_rows()
    got = quality_rules.judge(docs(spark, rows), []).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert {x.doc_id: tuple(x[n] for n in names) for x in got} == {x[0]: brute_stats(x[1]) for x in rows}
    assert all(x.base_failed == (x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words) and x.kept == (not x.base_failed) for x in got)
    # filters on the result don't make the optimiser repeat the work for each word
    assert quality_rules.judge(docs(spark, rows), []).where("kept AND n_repeat_words >= 0").count() == sum(x.kept for x in got)


def test_quality_long_texts(spark):
    text = " ".join(["a b c d"] + [str(i) for i in range(1 << 20)] + ["a b c d"])
    got = quality_rules.judge(docs(spark, [(1, text, "en", "s", 0)]), []).first()
    assert got.n_repeat_words == 8 and got.n_words == (1 << 20) + 8


def test_decision_list_learns_and_orders():
    r = random.Random(9)
    rows = []
    for _ in range(900):
        f = {name: r.random() for name in quality_rules.FEATURES}
        rows.append((f, f["symbols_per_word"] > 0.7 or (f["upper_rate"] > 0.8 and f["digit_rate"] <= 0.5)))
    rules = quality_rules.learn(rows)
    assert 2 <= len(rules) <= quality_rules.MAX_RULES
    right = sum(any(all(c.holds(f) for c in rule) for rule in rules) == bad for f, bad in rows)
    assert right / len(rows) > 0.95
    assert rules == quality_rules.learn(rows) and quality_rules.learn([]) == []


def test_decision_list_predicts_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    rows = quality_rules.sample(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    train, test = [x for k, x in enumerate(rows) if k % 5], rows[::5]
    rules = quality_rules.learn(train)
    right = sum(any(all(c.holds(f) for c in rule) for rule in rules) == bad for f, bad in test)
    assert len(test) > 100 and right >= 0.95 * len(test)


def test_quality_on_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {x.doc_id: x for x in queries.op8_quality_rules(spark, sf).collect()}
    labels = [x for x in spark.read.parquet(f"{sf}/labels.parquet").collect() if not got[x.doc_id].base_failed]
    assert sum(got[x.doc_id].kept == (x.quality == 1) for x in labels) >= 0.97 * len(labels)


def test_simhash_components(spark, copied):
    r = random.Random(10)
    rows = list(copied)
    base = passages(77, 1, 300)[0].split()
    for i in range(60):
        w = list(base)
        w[r.randrange(300)] = f"x{i % 9}"
        rows.append((300 + i, " ".join(w).title(), "en", "s", 0))
    rows += [(900 + x[0], *x[1:]) for x in odd_rows()]
    got = {x.doc_id: (x.fp & (1 << 64) - 1, x.component_id) for x in simhash_dedup.near_duplicates(docs(spark, rows)).collect()}
    prints, comps = brute.near_duplicates([(x[0], x[1]) for x in rows])
    assert {k: v[0] for k, v in got.items()} == prints
    assert {k: v[1] for k, v in got.items()} == comps


@pytest.mark.parametrize("group", [4, 64, 1 << 16])
def test_trie_join_finds_all_links(spark, group):
    r = random.Random(11)
    prints = {0, (1 << 64) - 1}
    for _ in range(30):
        center = r.getrandbits(64) & r.choice([(1 << 64) - 1, (1 << 20) - 1])
        for _ in range(30):
            p = center
            for b in r.sample(range(64), r.randint(0, 3)):
                p ^= 1 << b
            prints.add(p)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    edges = simhash_dedup.links(df, group)
    got = {x.node: x.root for x in simhash_dedup.components(edges).collect()}
    want = brute.cluster({signed(p): p for p in prints})
    # a forest: no more edges than members, each within a component
    sent = edges.collect()
    assert all(want[x.u] == want[x.v] for x in sent) and (group < 1 << 16 or len(sent) <= 4 * len(prints))
    assert {n: got.get(n, n) for n in want} == want


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200) if i % 67] + [(500, 900), (500, 700)], "u long, v long")
    got = {x.node: x.root for x in simhash_dedup.components(edges).collect()}
    # i and i + 1 are linked unless 67 divides i
    assert got[67] == 1 and got[134] == 68 and got[200] == 135
    assert {got[500], got[700], got[900]} == {500}
    assert simhash_dedup.components(edges.limit(0)).collect() == []


def test_null_ids_in_near_duplicates(spark):
    rows = [(None, "a b c d", None, None, 0), (4, "a b c d", None, None, 0), (4, "a b c d", None, None, 0), (None, "zz yy xx ww vv", None, None, 0)]
    got = sorted((str(x.doc_id), str(x.component_id)) for x in simhash_dedup.near_duplicates(docs(spark, rows)).collect())
    assert got == [("4", "4"), ("4", "4"), ("None", "4"), ("None", "None")]
    assert simhash_dedup.near_duplicates(docs(spark, rows).limit(0)).collect() == []


def brute_tokens(word, vocabulary, ranked):
    text, score = token_count.MARK + word, {p: -math.log(k + 2) for k, p in reversed(list(enumerate(ranked)))}
    best = [(0.0, 0)]
    for j in range(1, len(text) + 1):
        size = len(text[j - 1].encode())
        options = [(best[j - 1][0] + size * vocabulary.byte_score, -(-best[j - 1][1] + size))]
        options += [(best[i][0] + score[text[i:j]], best[i][1] - 1) for i in range(j) if text[i:j] in score]
        best.append(max(options))
    return -best[-1][1]


def test_token_counts(spark):
    r = random.Random(12)
    ranked = ["▁", "a", "b", "ab", "▁a", "▁ab", "ba", "bb", "abba", "é", "▁bb"]
    vocabulary = token_count.Vocabulary(ranked)
    rows = odd_rows() + [(100 + i, " ".join("".join(r.choices("abé中", k=r.randint(1, 9))) for _ in range(r.randint(0, 40))), None, None, 0) for i in range(80)]
    got = {x.doc_id: (x.n_words, x.n_tokens) for x in token_count.count_tokens(docs(spark, rows), vocabulary).collect()}
    assert got == {x[0]: (len(brute.words(x[1])), sum(brute_tokens(w, vocabulary, ranked) for w in brute.words(x[1]))) for x in rows}
    assert token_count.count_tokens(docs(spark, rows).limit(0), vocabulary).collect() == []


def test_trie_shares_prefixes_and_tells_counts():
    r = random.Random(13)
    ranked = ["▁", "a", "b", "ab", "▁a", "▁ab", "ba", "bb", "abba", "é", "▁bb"]
    vocabulary = token_count.Vocabulary(ranked)
    words = sorted({"".join(r.choices("abé中", k=r.randint(1, 40))) for _ in range(300)} | {"ab" * 300, "ab" * 300 + "b"})
    trie = token_count.Trie(vocabulary, [token_count.MARK + w for w in words])
    assert trie.counts() == [brute_tokens(w, vocabulary, ranked) for w in words]
    # a node for each prefix, once
    assert len(trie.parent) == 1 + len({(token_count.MARK + w)[:k] for w in words for k in range(1, len(w) + 2)})

    def spelled(node):
        return "" if node == 0 else spelled(trie.parent[node]) + trie.char[node]

    assert [spelled(t) for t in trie.terminal[:250]] == [token_count.MARK + w for w in words[:250]]
    assert token_count.Trie(vocabulary, []).counts() == []


def test_tries_and_memory_of_any_size_count_alike(spark):
    rows = odd_rows() + [(100 + i, t, None, None, 0) for i, t in enumerate(passages(3, 20, 200))]
    want = {x.doc_id: x.n_tokens for x in token_count.count_tokens(docs(spark, rows)).collect()}
    vocabulary = token_count.Vocabulary.load()
    single = {x: token_count.Trie(vocabulary, [token_count.MARK + x]).counts()[0] for r in rows for x in brute.words(r[1])}
    assert want == {r[0]: sum(single[x] for x in brute.words(r[1])) for r in rows}


def test_vocabulary_takes_given_probabilities():
    vocabulary = token_count.Vocabulary(["▁", "a", "b", "ab"], [-1.0, -1.0, -1.0, -5.0])
    assert token_count.Trie(vocabulary, ["▁ab"]).counts() == [3] and vocabulary.byte_score == -7.0
    assert token_count.Trie(token_count.Vocabulary([]), ["aé"]).counts() == [3]


def test_every_query_returns_its_columns(spark):
    columns = {
        "op1_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
        "op2_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
        "op3_language_id": ["doc_id", "held_out", "lang_pred", "score"],
        "op5_mix_sources": ["doc_id", "size", "source_size", "target", "taken"],
        "op6_url_filter": ["page_id", "host", "path", "rule", "verdict"],
        "op8_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        "op9_simhash_dedup": ["doc_id", "fingerprint", "component_id"],
    }
    for name, wanted in columns.items():
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").columns[: len(wanted)] == wanted
