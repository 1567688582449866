"""Token files, toxicity and URL templates."""

import io
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from velum.llm import url_templates
from velum.llm.queries import QUERIES, URL_RULES
from velum.llm.shared import Scratch
from velum.llm.token_files import BLOCK, Encoder, Reader, Writer, token_files
from velum.llm.toxicity import Fit, Scorer, features, score_toxicity, toxicity, train
from velum.llm.url_templates import Rule, filter_urls

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def tokenizer():
    return tokenizers.Tokenizer.from_file(PATH)


def test_encoder_splits_like_the_tokenizer(tokenizer):
    texts = [
        "", " ", "a", " a", "a ", "a  b", "a \n b", "\n\n x", "don't we'll 've", "x<|endoftext|>y z",
        "naïve Ünder ½ ² ٣ x_y __ a-b (c) d!!! 12ab34 ñ,", "tab\tand\r\nend", "日本語 テキスト", "\0 nul",
        "word " * 300, "l" * 100 + " " + "m" * 60, "a\u00a0b c", "🙂🙂 x🙂", "a 's b", "e\u0301 x",
    ]
    encode = Encoder(open(PATH, encoding="utf-8").read())
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encode(texts) == want
    assert encode(texts) == want


def test_added_tokens(spark):
    plain = tokenizers.Tokenizer.from_file(PATH)
    texts = ["a<|endoftext|>b", "<|endoftext|>", "a b <|endoftext|> c<|endoftext|>", "<|endoftext>", "a  b"]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 50256, 65]
    encode = Encoder(open(PATH, encoding="utf-8").read())
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_files(docs, PATH).collect()}
    assert got == {k: (len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4"))) for k, x in enumerate(want)}


def test_file_round_trip():
    rnd = np.random.default_rng(1)
    documents = [(k, rnd.integers(0, 1 << 32, n, dtype="u4")) for k, n in enumerate([0, 1, BLOCK, 3 * BLOCK + 5, 7, 0])]
    documents.append((None, np.arange(10, dtype="u4")))
    out = io.BytesIO()
    writer = Writer(out)
    for i, ids in documents:
        writer.add(i, ids.tobytes())
    writer.close()
    reader = Reader(out, out.getbuffer().nbytes)
    got = list(reader)
    assert [i for i, _ in got] == [i for i, _ in documents]
    assert all((a == b).all() for (_, a), (_, b) in zip(got, documents))
    whole = np.concatenate([ids for _, ids in documents])
    assert (reader.block(2) == whole[2 * BLOCK : 3 * BLOCK]).all()
    with pytest.raises(ValueError):
        Reader(io.BytesIO(b"x" * 100), 100)


def test_token_files(docs, rows, no_docs, tokenizer):
    got = token_files(docs, PATH).collect()
    ids = [(i, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")) for i, t, *_ in rows]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(
        (i, len(x), zlib.crc32(x)) for i, x in ids
    )
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id if r.doc_id is not None else -1 for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)
    assert token_files(no_docs, PATH).count() == 0


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op7_toxicity"](spark, sf).collect()}
    assert len(got) == 1000
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [(got[i].predicted, y) for i, y in labels.items() if got[i].held_out]
    assert sum(p == y for p, y in judged) / len(judged) > 0.93
    clean = [p for p, y in judged if not y]
    assert sum(clean) / len(clean) < 0.03


def test_toxicity_of_awkward_rows(spark, docs, rows, no_docs):
    labels = spark.createDataFrame([(i, i % 6 == 2, i) for i in range(120)], "doc_id long, toxic boolean, text long")
    labels = labels.selectExpr("doc_id", "cast(toxic AS int) AS toxic", "text")
    got = toxicity(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in rows)
    assert all(0 <= r.score <= 1 for r in got)
    none = toxicity(docs, labels.filter("toxic = 0")).collect()
    assert len({r.score for r in none}) == 1 and none[0].score < 0.5
    assert toxicity(no_docs, labels).count() == 0
    wide = docs.withColumnRenamed("lang", "a.b")
    scored = score_toxicity(wide, train([], [], 0.1))
    assert scored.columns == [*wide.columns, "toxicity"]


def test_non_negative_risk():
    """With separable words the classifier finds them although half of the toxic texts
    are among the unlabelled."""
    rnd = np.random.default_rng(2)
    text = lambda bad: " ".join(f"w{k}" for k in rnd.integers(0, 300, 30)) + (" nasty" if bad else "")
    positive = [features(text(True)) for _ in range(80)]
    unlabelled = [features(text(k % 10 == 0)) for k in range(800)]
    scorer = Scorer(train(positive, unlabelled, 0.1, Fit()))
    assert scorer(text(True)) > 0.5 > scorer(text(False))
    assert scorer("") < 0.5


def tree_verdicts(pages):
    """The same tree in plain Python: pages as (host, typed path, ruled verdict)."""
    n, bad, good = Counter(), Counter(), Counter()
    for host, typed, ruled in pages:
        n[host, typed] += 1
        bad[host, typed] += ruled == "block"
        good[host, typed] += ruled == "allow"
    every, wrong = Counter(), Counter()
    for k in n:
        every[k[0]] += n[k]
        wrong[k[0]] += bad[k]
    prior = sum(wrong[h] / every[h] for h in every) / max(1, len(every))
    weight = url_templates.SMOOTHING
    template = {k: "" for k in n}
    purity = {k: (wrong[k[0]] + weight * prior) / (every[k[0]] + weight) for k in n}
    going = set(n)

    def share(a, b):
        return math.floor(math.asin(math.sqrt(a / b)) / url_templates.BIN)

    level = 0
    while going := {k for k in going if len(k[1]) > level}:
        kinds, total = defaultdict(set), Counter()
        for k in going:
            kinds[k[0], template[k]].add(k[1][level])
            total[k[0], template[k]] += n[k]
        child, sums = {}, defaultdict(lambda: [0, 0, 0])
        for k in going:
            at = k[0], template[k]
            many = len(kinds[at]) >= url_templates.MANY_CHILDREN
            child[k] = "{any}" if many and total[at] < url_templates.PAGES_PER_CHILD * len(kinds[at]) else k[1][level]
            for j, v in enumerate((n[k], bad[k], good[k])):
                sums[(*at, child[k])][j] += v
        alike = defaultdict(list)
        for (host, node, c), (a, b, g) in sums.items():
            key = (share(b + g, a), share(b, b + g)) if b + g else (c,)
            alike[host, node, key].append(c)
        name, labels = {}, defaultdict(lambda: [0, 0])
        for (host, node, _), cs in alike.items():
            for c in cs:
                name[host, node, c] = branch = f"{{like {min(cs)}}}" if len(cs) > 1 else c
                labels[host, node, branch][0] += sums[host, node, c][1]
                labels[host, node, branch][1] += sums[host, node, c][2]
        level += 1
        for k in list(going):
            branch = name[k[0], template[k], child[k]]
            b, g = labels[k[0], template[k], branch]
            purity[k] = (b + weight * purity[k]) / (b + g + weight)
            template[k] += "/" + branch
            if level >= url_templates.DEPTH and not (b and g):
                template[k] += "/{deep}" if len(k[1]) > level else ""
                going.discard(k)
    return {k: (template[k], purity[k]) for k in n}


def test_deep_paths_are_told_apart(spark):
    """Below ``DEPTH`` segments good and bad branches are still judged apart."""
    deep = "/".join("abcdefghij")
    rows = [(k, f"http://h.example/{deep}/{'spam' if k % 2 else 'news'}/x{k // 2 % 5}/{k}") for k in range(200)]
    rows += [(500 + k, f"http://other.example/{deep}/y/{k}") for k in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = tuple(Rule("block", "h.example", f"/{deep}/spam/x{d}") for d in range(4))
    rules += tuple(Rule("allow", "h.example", f"/{deep}/news/x{d}") for d in range(4))
    got = filter_urls(pages, rules).collect()
    learned = {r.path.split("/")[11]: r.verdict for r in got if r.rule is None and r.host == "h.example"}
    assert learned == {"spam": "block", "news": "allow"}
    assert {r.template.count("/") for r in got if r.host == "other.example"} == {9}
    typed = {r.page_id: tuple(r.t) for r in pages.select("page_id", url_templates.typed_segments(url_templates.path_of(pages["url"])).alias("t")).collect()}
    ruled = {r.page_id: r.verdict if r.rule else None for r in got}
    tree = tree_verdicts([(r.host, typed[r.page_id], ruled[r.page_id]) for r in got])
    for r in got:
        template, purity = tree[r.host, typed[r.page_id]]
        assert r.template == template and abs(r.purity - purity) < 1e-9


def test_labels_of_a_host_reach_its_other_branches(spark):
    """A host whose pages are mostly bad, one that is mostly good, and one without labels."""
    rows = [(k, f"http://{h}.example/{'x' if k % 10 < share else 'y'}/p{k % 7}") for h, share in (("bad", 9), ("good", 1), ("new", 5)) for k in range(100)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = filter_urls(pages, (Rule("block", "bad.example", "/x"), Rule("block", "good.example", "/x"))).collect()
    assert {(r.host, r.verdict) for r in got if r.rule is None} == {
        ("bad.example", "block"), ("good.example", "allow"), ("new.example", "allow")
    }


def test_urls_against_plain_python(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    typed = pages.select("page_id", url_templates.typed_segments(url_templates.path_of(pages["url"])).alias("t"))
    typed = {r.page_id: tuple(r.t) for r in typed.collect()}
    url = {r.page_id: r.url for r in pages.select("page_id", "url").collect()}
    got = {r.page_id: r for r in filter_urls(pages, URL_RULES).collect()}
    assert got.keys() == url.keys()
    ruled = {}
    for i, u in url.items():
        host, path = re.match(r".*?://([^/?#]*)([^?#]*)", u).groups()
        host = host.lower()
        fit = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fit, key=lambda r: len(r.name), default=None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule and rule.name)
        ruled[i] = rule and rule.verdict
    tree = tree_verdicts([(got[i].host, typed[i], ruled[i]) for i in url])
    assert len({round(got[i].purity, 9) for i in url if ruled[i] is None}) > 20
    for i in url:
        template, purity = tree[got[i].host, typed[i]]
        assert got[i].template == template and abs(got[i].purity - purity) < 1e-9
        assert got[i].verdict == (ruled[i] or ("block" if purity >= 0.5 else "allow"))


def test_awkward_urls(spark):
    rows = [
        (1, None), (2, "no scheme"), (3, "http://A.Example.NET?x=/en/"), (4, "ftp://x.org/fr/#a"),
        (None, "x://"), (6, "http://net/a://b"), (6, "http://net/a://b"), (7, "http://notnet/de/"),
        (8, "https://example.com/de/" + "s/" * 5000), (9, "https://EXAMPLE.com/de"), (10, "://h/é?q"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS n", "3 AS rule")
    got = filter_urls(pages, URL_RULES).collect()
    assert Counter((r.page_id, r.host, r.path[:8], r.rule) for r in got) == Counter(
        [
            (1, "", "", None), (2, "", "", None), (3, "a.example.net", "", None), (4, "x.org", "/fr/", "org/fr/"),
            (None, "", "", None), (6, "net", "/a://b", "net/"), (6, "net", "/a://b", "net/"),
            (7, "notnet", "/de/", None), (8, "example.com", "/de/s/s/", "example.com/de/"),
            (9, "example.com", "/de", None), (10, "h", "/é", None),
        ]
    )
    assert {r.verdict for r in got} <= {"allow", "block"}
    assert filter_urls(pages.limit(0), URL_RULES).count() == 0
    with pytest.raises(ValueError):
        filter_urls(pages, tuple(Rule("block", str(k), "/") for k in range(10_001)))


def test_templates_reject_by_purity(spark):
    """Bad pages under /spam/ of one host take the pages of that template along that no
    rule names; other branches stay."""
    rows = [(k, f"http://h.example/{'spam' if k % 2 else 'news'}/{k}.html") for k in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = tuple(Rule("block", "h.example", f"/spam/{d}") for d in "123456789"[:6])
    got = filter_urls(pages, rules).collect()
    learned = [r for r in got if r.rule is None]
    assert all(r.verdict == ("block" if "/spam/" in r.path else "allow") for r in learned)
    assert any("/spam/" in r.path for r in learned)


def test_scratch_drops(spark):
    scratch = Scratch(spark)
    kept = scratch.keep(spark.range(5), "five")
    assert kept.count() == 5
    scratch.drop("five")
    with pytest.raises(Exception):
        spark.read.parquet(f"{scratch.root}/five").count()
