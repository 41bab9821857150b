"""WARC round trips, URL rules and perspective rotation by brute force."""

import gzip
import hashlib
import io
import json
import zlib

import pytest

from strata.llm import warc
from strata.llm.chat import ChatOptions, render_perspectives, rotated_turns
from strata.llm.queries import URL_RULES
from strata.llm.url_filter import Trie, judge_urls

BIG = "<p>" + "x" * 1200 + "</p>"
PAGES = [
    (1, "http://a.example/1", BIG),
    (2, "http://a.example/2", BIG),
    (3, None, BIG),
    (3, "http://again", BIG),
    (4, "http://short/1", "short"),
    (5, "http://short/2", "short"),
    (6, "http://null", None),
    (7, "http://ünï/\r\nInjected: yes", "é" * 600),
    (8, "http://ünï", "é" * 600),
    (9, "http://long", "y" * 3_000_000),
    (None, "http://noid", BIG),
    (10, "http://crlf", "\r\n\r\nWARC/1.1\r\n\r\n"),
]


def expected(pages):
    best = {}
    for i, _, h in pages:
        data = (h or "").encode()
        if len(data) >= 1000 and i is not None:
            best[data] = max(best.get(data, i), i)
    out = []
    for i, _, h in pages:
        data = (h or "").encode()
        refers = best.get(data)
        revisit = refers is not None and i != refers
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", refers if revisit else None))
    return sorted(out, key=repr)


def test_warc_round_trip(spark, tmp_dir):
    pages = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id bigint, url string, html string, archive string").repartition(3)
    index = warc.archive_pages(pages, tmp_dir)
    rows = warc.read_records(index).collect()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows]
    assert sorted(got, key=repr) == expected(PAGES)
    html = {(i, (h or "").encode()) for i, _, h in PAGES}
    assert all((r.page_id, bytes(r.payload)) in html for r in rows if r.record_type == "response")
    assert {r.url for r in rows if r.page_id == 7} == {"http://ünï/%0D%0AInjected: yes"}
    # every record is a gzip member of its own, as the sidecar index says
    entries = index.collect()
    for path in {e.archive for e in entries}:
        data = open(path, "rb").read()
        side = [json.loads(x) for x in open(f"{path}.idx", encoding="utf-8")]
        assert sum(s["length"] for s in side) == len(data)
        for s in side:
            member = zlib.decompressobj(wbits=31)
            record = member.decompress(data[s["offset"] : s["offset"] + s["length"]])
            assert member.eof and not member.unused_data and record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            assert s["record_id"].encode() in record
        # and a reader that knows nothing of members reads the whole file
        assert gzip.decompress(data).count(b"WARC/1.1\r\nWARC-Type") == len(side)


def test_warc_of_empty_table(spark, tmp_dir):
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.read_records(warc.archive_pages(none, tmp_dir)).count() == 0


def test_archives_are_closed_at_their_size(spark, tmp_dir):
    pages = spark.range(50).selectExpr("id as page_id", "'http://x' as url", "repeat(cast(id as string), 2000) as html").coalesce(1)
    opt = warc.WarcOptions(max_archive_bytes=10_000)
    index = warc.archive_pages(pages, tmp_dir, opt)
    assert index.select("archive").distinct().count() > 5
    assert warc.read_records(index, payloads=False).count() == 50


def test_damaged_streams_are_refused():
    whole = gzip.compress(warc.response_head(1, "http://x", 5, hashlib.sha1(b"hello").hexdigest()) + b"hello\r\n\r\n")
    assert [f["x-page-id"] for f, _, _ in warc.records(io.BytesIO(whole))] == ["1"]
    assert list(warc.records(io.BytesIO(b""))) == []
    for bad in (whole[:-20], gzip.compress(b"HTTP/1.1 200 OK\r\n\r\n"), gzip.compress(b"WARC/1.1\r\nContent-Length: 50\r\n\r\nshort")):
        with pytest.raises((EOFError, ValueError)):
            list(warc.records(io.BytesIO(bad)))


# --- urls ------------------------------------------------------------------


def brute_rule(host, path, rules):
    fits = [(len(h.split(".")), len(p), v != "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    top = max(fits, key=lambda f: (f[0], f[1], not f[2]), default=None)
    return (top[3], top[4]) if top else (None, "allow")


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    tail = rest[cut:]
    end = min((tail.find(c) for c in "?#" if c in tail), default=len(tail))
    return host, tail[:end]


URLS = [
    None, "", "no scheme", "http://", "http:///en/", "HTTP://WWW.Example.COM/en/1?x#y", "https://example.com/en", "https://example.com/en/", "https://a.b.example.com/en/x",
    "https://com/", "https://com", "ftp://x.net/es/1", "https://net/fr/?q", "https://x.net/EN/", "http://notexample.com/en/", "http://example.com:80/en/", "http://a.com#f/en/",
    "x://y://z.com/", "http://ÉÀ.com/é\n/x", "http://.com/", "http://com./", "http://example.com?/en/",
]


def test_urls_equal_brute_force(spark):
    rules = [*URL_RULES, ("block", "org", "/a"), ("allow", "org", "/ab/c"), ("allow", "ORG", "/a"), ("block", "x.y.org", "")]
    urls = [*URLS, "http://q.org/abc", "http://q.org/ab/cd", "http://z.x.y.org", "http://q.org/a"]
    df = spark.createDataFrame([(k, u, "mine") for k, u in enumerate(urls)] + [(0, None, "mine")], "page_id int, url string, Host string")
    for shard in (200_000, 2):
        out = judge_urls(df, rules, shard_rules=shard)
        assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
        rows = out.collect()
        assert len(rows) == len(urls) + 1
        for r in rows:
            host, path = split_url(r.url)
            assert (r.host, r.path) == (host, path)
            assert (r.rule, r.verdict) == brute_rule(host, path, [(v, h.lower(), p) for v, h, p in rules]), r.url
    assert judge_urls(df.where("page_id < 0"), rules).count() == 0
    assert {r.verdict for r in judge_urls(df, [], default="block").collect()} == {"block"}
    with pytest.raises(ValueError):
        judge_urls(df, [("maybe", "com", "/")])


def test_trie_prefers_the_longest_way():
    t = Trie([("allow", "com", "/"), ("block", "com", "/a/b"), ("allow", "com", "/a/b/c/"), ("block", "x.com", "")])
    assert t.match("y.com", "/a/bb")[2:] == ("com/a/b", "block")
    assert t.match("y.com", "/a/b/c/d")[2:] == ("com/a/b/c/", "allow")
    assert t.match("x.com", "/a/b/c/d")[2:] == ("x.com", "block")
    assert t.match("org", "/") is None


# --- chat ------------------------------------------------------------------

TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hello, ann"), (1, 3, "ann", "bye\nnow"), (1, 3, "ann", "bye\nnow"), (1, 3, "bob", "tie"),
    (2, 0, "system", "only rules"), (3, 0, "solo", None), (3, None, None, "first"), (None, 5, "x", "lost"), (None, 5, "y", ""), (4, -2, "user", "é🙂"),
]


def brute_render(turns, system=("system",)):
    by_conv = {}
    for c, t, r, x in turns:
        by_conv.setdefault(c, {}).setdefault((t, r or "", x or ""), 0)
    out = {}
    for conv, seen in by_conv.items():
        order = sorted(seen, key=lambda k: (k[0] is not None, k[0] or 0, hashlib.md5(f"{k[1]}\0{k[2]}".encode()).hexdigest(), k[1], k[2]))
        for who in {r for _, r, _ in seen} - set(system):
            text, mask = "", []
            for _, role, body in order:
                head = "<|assistant|>\n" if role == who else "<|system|>\n" if role in system else f"<|user:{role}|>\n"
                text += head
                if role == who:
                    mask.append(f"{len(text)}-{len(text) + len(body) + 1}")
                text += body + "\n"
            out[(conv, who)] = (text, ",".join(mask))
    return out


def test_rotation_equals_brute_force(spark):
    df = spark.createDataFrame([(*t, "x") for t in TURNS], "conv_id bigint, turn bigint, role string, text string, start string")
    want = brute_render(TURNS)
    got = {(r.conv_id, r.perspective): (r.text, r["mask"]) for r in render_perspectives(df).collect()}
    assert got == want
    # in small blocks the parts join to the same text, and masks stay absolute
    parts = {}
    for r in sorted(render_perspectives(df, ChatOptions(block_chars=12)).collect(), key=lambda r: r.start):
        t, m = parts.get((r.conv_id, r.perspective), ("", []))
        assert r.start == len(t)
        parts[(r.conv_id, r.perspective)] = (t + r.text, m + ([r["mask"]] if r["mask"] else []))
    assert {k: (t, ",".join(m)) for k, (t, m) in parts.items()} == want
    twice = rotated_turns(df).where("n_copies = 2").collect()
    assert {r.rendered for r in twice} == {"<|assistant|>\nbye\nnow\n", "<|user:ann|>\nbye\nnow\n"}


def test_one_hot_conversation_over_many_tasks(spark):
    df = spark.range(5000).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'a', 'b') as role", "concat('t', id) as text")
    rows = df.collect()
    turns = rotated_turns(df).collect()
    want = brute_render([tuple(r) for r in rows])
    for who in ("a", "b"):
        own = sorted((r for r in turns if r.perspective == who), key=lambda r: r.start)
        assert "".join(r.rendered for r in own) == want[(7, who)][0]
        assert all(x.end == y.start for x, y in zip(own, own[1:]))


def test_chat_of_empty_table(spark):
    assert render_perspectives(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def test_chat_plan_is_native(spark):
    df = spark.createDataFrame(TURNS, "conv_id bigint, turn bigint, role string, text string")
    plan = render_perspectives(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
