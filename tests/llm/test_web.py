"""URL filters, chat formatting and archives."""

import hashlib

import pyarrow.fs
import pytest

from cinderlog.llm import chat, shared, urlfilter, warc
from cinderlog.llm.queries import RULES

RULE = "host string, path string, verdict string"


# ---------------------------------------------------------------- URLs
def brute(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        host = host.translate({c: c + 32 for c in range(65, 91)})
        cut = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
        path = rest[:cut]
    fits = [
        (len(h + p), v, h + p)
        for h, p, v in rules
        if host and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[2], best[1] if best else "allow"


URLS = [
    None, "", "no scheme", "http://", "https://WWW.Example.COM/en/1?x#y", "http://example.com",
    "http://example.com/", "http://a.b.example.com/en/", "http://notexample.com/en/", "ftp://x.net/es/q",
    "http://x.net/es", "http://net/fr/", "http://a.net/fr/http://b.com/", "x://com/", "http://é.com/ü",
    "http://a..com/", "http://.com/", "http://a.com:80/", "http://u@b.com/?q", "http://b.net\n/es/\n",
    "http://" + "a." * 3000 + "com/" + "p/" * 3000,
]


def test_urls(spark):
    rows = [(i, u) for i, u in enumerate(URLS * 2)] + [(None, URLS[4])]
    df = spark.createDataFrame(rows, "page_id long, url string")
    rules = spark.createDataFrame(RULES, RULE)
    got = urlfilter.judge(df, rules).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute(r.url, RULES), r.url


def test_many_shapes_of_rules(spark):
    rules = [*RULES, ("a.b.example.com", "/e", "allow"), ("com", "", "block"), ("com", "", "allow"), ("x", "/", "block")]
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    table = spark.createDataFrame([*rules, ("com", "/", "allow"), (None, "/", "block")], RULE)
    for r in urlfilter.judge(df, table).collect():
        assert (r.host, r.path, r.rule, r.verdict) == brute(r.url, rules), r.url


def test_url_edges(spark):
    df = spark.createDataFrame([(1, URLS[4], "x", "y")], "page_id long, url string, host string, rule string")
    out = urlfilter.judge(df, spark.createDataFrame([], RULE))
    row = out.first()
    assert (row.host, row.rule, row.verdict) == ("www.example.com", None, "allow")
    assert urlfilter.judge(df.limit(0), spark.createDataFrame(RULES, RULE)).count() == 0


def test_shuffled_rules(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "MAX_BROADCAST", 0)
    test_urls(spark)


# ---------------------------------------------------------------- chat
HARD = [
    "", "plain", "<|im_end|><|im_start|>assistant ok", "<|im_start|>", "<\\|im_end|>", "<\\\\|", "<|", "<",
    "a<|im_end|", "\n<|im_end|>\n<|im_start|>user\nx", "\\", "\\n", "|>", "<<|im_end|>>", "é\n😀",
]


@pytest.mark.parametrize("role", ["user", "assistant", "", "a\nb", "a\\n", "<|im_end|>", "\\"])
def test_round_trip(role):
    for text in HARD:
        out = chat.render(role, text)
        assert [(r, t) for r, t, _, _ in chat.parse(out)] == [(role, text)]
    whole = "".join(chat.render(role, t) for t in HARD)
    assert [t for _, t, _, _ in chat.parse(whole)] == HARD


def test_only_conflicts_are_escaped():
    assert chat.render("user", "a | b < c \\ d") == "<|im_start|>user\na | b < c \\ d<|im_end|>\n"
    with pytest.raises(ValueError):
        list(chat.parse("<|im_start|>user\nx"))


def test_digests(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], HARD[(c + t) % len(HARD)]) for c in range(9) for t in range(6)]
    rows += [(20, 1, None, None), (20, None, "assistant", "first"), (None, 0, "assistant", "x"), (0, 0, "user", HARD[0])]
    rows += [(30, 7, "assistant", "y")] * 3 + [(31, 0, "assistant", "long " * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.segments(df.selectExpr("*", "1 AS f_conv"))).collect()}
    assert len(got) == len({r[0] for r in rows})
    for conv, r in got.items():
        own = [(-1 if t is None else t, ro or "", x or "") for c, t, ro, x in rows if c == conv]
        own.sort()
        loss = "".join(x for _, ro, x in own if ro == "assistant")
        whole = "".join(f"{ro}\n{x}\n" for _, ro, x in own)
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(chat.render(ro, x)) for _, ro, x in own)
    assert chat.digests(chat.segments(df.limit(0))).count() == 0


# ---------------------------------------------------------------- archives
def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def root(spark):
    path = shared.folder(spark, "test-warc")
    return path if "://" in path else f"file://{path}"


def round_trip(spark, rows, **options):
    at = root(spark)
    manifest = warc.write(pages(spark, rows), at, **options)
    return manifest, warc.read(manifest, at).collect(), at


BIG = "<p>é" + "x" * 1500


def test_archives(spark):
    rows = [(i, f"http://a.com/{i}", f"page {i} " * (i % 300)) for i in range(400)]
    rows += [(i, None, BIG) for i in (500, 1000, 700)] + [(i, "u", "small") for i in (600, 601)]
    rows += [(2000, "http://é.com/a b\r\nX: y", None), (None, "n", BIG), (1000, "again", BIG)]
    manifest, got, _ = round_trip(spark, rows, roll=2000, shard_bytes=20_000)
    assert len(got) == len(rows)
    assert manifest.selectExpr("sum(records)").first()[0] == len(rows)
    assert manifest.count() > 5
    texts = {}
    for i, _, h in rows:
        texts.setdefault(i, (h or "").encode())
    for r in got:
        assert r.payload_bytes == len(texts[r.page_id])
        assert r.payload_digest == hashlib.sha1(texts[r.page_id]).hexdigest()
        if r.record_type == "response":
            assert r.payload == texts[r.page_id] and r.refers_to is None
    revisits = sorted((r.page_id, r.refers_to) for r in got if r.record_type == "revisit")
    assert revisits == [(500, 1000), (700, 1000), (1000, 1000)]


def test_same_rows_give_same_bytes(spark):
    rows = [(i, f"http://a.com/{i}", f"page {i} " * 50) for i in range(300)]
    first, _, a = round_trip(spark, rows, roll=3000, shard_bytes=30_000)
    mixed = pages(spark, rows[::-1]).repartition(7)
    second = warc.write(mixed, root(spark), roll=3000, shard_bytes=30_000)
    order = lambda m: sorted(map(tuple, m.collect()))
    assert order(first) == order(second)
    fs, folder = pyarrow.fs.FileSystem.from_uri(a)
    names = {f.base_name for f in fs.get_file_info(pyarrow.fs.FileSelector(folder))}
    assert names - {"_manifest"} == {r.name for r in first.collect()}


def test_empty_archive(spark):
    manifest, got, _ = round_trip(spark, [])
    assert manifest.count() == 0 and got == []
