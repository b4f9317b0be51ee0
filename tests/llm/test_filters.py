import hashlib
import re
import zlib
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from brindle.llm import cascade, chat, decontam, pii, textkit, toxicity, urlrules, warc

from .conftest import prose

# Chat -----------------------------------------------------------------------------


def test_perspectives(spark):
    turns = [(1, 0, "ann", "hi"), (1, 1, "bob", "yo"), (1, 2, "cy", None), (1, 3, None, "?"), (2, 0, "ann", "alone"), (None, 0, "x", "y"), (3, None, "x", "y")]
    turns += [(4, k, "ab"[k % 2], "t") for k in range(7)] + [(4, 3, "b", "t")]
    frame = spark.createDataFrame([(*t, "e", 1) for t in turns], "conv_id long, turn long, role string, text string, speaker string, segment int")
    rows = {(r.conv_id, r.speaker, r.segment): r for r in chat.rotate_perspectives(frame, 4).collect()}
    assert set(rows) == {(1, s, 0) for s in ("ann", "bob", "cy")} | {(2, "ann", 0)} | {(4, s, g) for s in "ab" for g in (0, 1)}
    one = rows[1, "bob", 0]
    head, end = "<|im_start|>", "<|im_end|>\n"
    assert one.rendered == f"{head}user name=ann\nhi{end}{head}assistant\nyo{end}{head}user name=cy\n{end}{head}user\n?{end}"
    assert (one.mask, one.n_messages, one.n_trained) == ("0100", 4, 1)
    a, b = map(int, one.mask_spans.split(":"))
    assert one.rendered[a:b] == "yo"
    assert rows[4, "b", 0].n_messages == 5 and rows[4, "b", 1].n_messages == 3
    assert chat.rotate_perspectives(frame.limit(0)).count() == 0


def test_pieces_of_a_dialogue_concatenate(spark):
    """Long, tied, repeated and empty-role turns: the pieces at any size are the whole rendering."""
    turns = [(1, k // 2, ["ann", "bob", "", None][k % 4], f"t{k % 5}" * (k % 7)) for k in range(900)]
    turns += [(2, 5, r, t) for r in ("x", "y") for t in ("same", "same", None, "")] + [(3, -3, "a", "z" * 300_000), (3, 400, "b", "q")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")

    def whole(size):
        found = {}
        for r in sorted(chat.rotate_perspectives(frame, size).collect(), key=lambda r: (r.conv_id, r.speaker, r.segment)):
            text, mask, spans = found.get((r.conv_id, r.speaker), ("", "", []))
            assert r.start == len(text)
            found[r.conv_id, r.speaker] = (text + r.rendered, mask + r.mask, spans + [s for s in r.mask_spans.split(",") if s])
        return found

    one = whole(10**6)
    assert set(one) == {(1, "ann"), (1, "bob"), (2, "x"), (2, "y"), (3, "a"), (3, "b")}
    assert one == whole(chat.TURNS_PER_SEGMENT) == whole(7)
    text, mask, spans = one[1, "bob"]
    assert len(mask) == 900 and len(spans) == mask.count("1") == 225
    own = sorted((t, c or "") for _, t, r, c in turns[:900] if r == "bob")
    assert [text[int(a) : int(b)] for a, b in (s.split(":") for s in spans)] == [c for _, c in own]


# URLs -----------------------------------------------------------------------------


def test_explicit_rules(spark):
    urls = {
        "http://a.ORG/x": ("a.org", "/x", "org/", "allow"),
        "https://example.org/es/1": ("example.org", "/es/1", "example.org/es/", "block"),
        "http://m.example.org/en/12?q": ("m.example.org", "/en/12", "example.org/en/1", "allow"),
        "http://x.com/de/": ("x.com", "/de/", "com/de/", "block"),
        "http://notexample.org": ("notexample.org", "", None, None),
        "http://xcom/fr/": ("xcom", "/fr/", None, None),
        "no scheme": ("", "", None, None),
        None: ("", "", None, None),
        "": ("", "", None, None),
        "a://b?c://d": ("b", "", None, None),
    }
    rows = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(urls)], "page_id long, url string, html string, rule string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in urlrules.judge_urls(rows, labels).collect()}
    for k, (host, path, rule, verdict) in enumerate(urls.values()):
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        assert got[k].verdict == (verdict or "allow")
    assert urlrules.judge_urls(rows.limit(0), labels).count() == 0


def test_mined_rules_against_brute_force(spark):
    pages = [(k, f"http://{'casino' if k % 4 == 0 else 'news'}-{k % 3}.net/{'win' if k % 2 == 0 else 'read'}/{k}") for k in range(240)]
    labels = spark.createDataFrame([(k, 0 if k % 4 == 0 else 1, 0) for k in range(0, 240, 2)] + [(None, 0, 1)], "doc_id long, quality int, toxic int")
    frame = spark.createDataFrame([*pages, (None, "http://casino-1.net/win/9"), (7000, None)], "page_id long, url string")
    rows = urlrules.judge_urls(frame, labels).collect()
    assert all((r.verdict == "block") == ("casino" in r.host) for r in rows)
    index = urlrules.inverted_index([(("a", "b"), 0.9), (("c",), 0.6), (("b", "c"), 0.8)])
    for tokens in ([], ["a"], ["b", "a"], ["c"], ["c", "b"], ["a", "b", "c"]):
        want = max((c for need, c in [({"a", "b"}, 0.9), ({"c"}, 0.6), ({"b", "c"}, 0.8)] if need <= set(tokens)), default=0.0)
        assert urlrules.block_confidence(tokens, index) == want


def test_general_rules_outlast_many_implied_ones(spark):
    block = urlrules.LABEL
    rows = [([f"f{k}_{j}" for j in range(7)] + [block],) for k in range(165) for _ in range(5)]  # 63 raw rules a family
    rows += [(["general", *[block] * (k % 5 > 0)],) for k in range(100)] + [([f"clean{k % 50}"],) for k in range(1500)]
    rules = urlrules.mine_rules(spark.createDataFrame(rows, "items array<string>"))
    want = {(f"f{k}_{j}",): 1.0 for k in range(165) for j in range(7)} | {("general",): 0.8}
    assert len(rules) == len(want) and dict(rules) == want


def test_mining_against_enumeration(spark):
    """Support, confidence, lift and pruning of all token combinations, counted one by one."""
    from itertools import combinations

    draw = np.random.default_rng(11)
    baskets = []
    for _ in range(220):
        tokens = {t for t, p in zip("abcdefg", (0.9, 0.6, 0.5, 0.3, 0.2, 0.1, 1.0)) if draw.random() < p}
        bad = draw.random() < 0.1 + 0.5 * ("b" in tokens and "d" in tokens) + 0.3 * ("e" in tokens)
        baskets.append(sorted(tokens) + [urlrules.LABEL] * bool(bad))
    n, least = len(baskets), max(0.03 * len(baskets), 5)
    base = sum(urlrules.LABEL in b for b in baskets) / n
    found = {}
    for size in (1, 2, 3):
        for own in combinations("abcdef", size):
            with_own = [b for b in baskets if set(own) <= set(b)]
            bad = sum(urlrules.LABEL in b for b in with_own)
            if bad >= least and bad / len(with_own) >= 0.3 and bad / len(with_own) / base > 1 + 1e-9:
                found[own] = bad / len(with_own)
    want = {own: c for own, c in found.items() if not any(found.get(sub, -1) >= c for k in range(1, len(own)) for sub in combinations(own, k))}
    got = urlrules.mine_rules(spark.createDataFrame([(b,) for b in baskets], "items array<string>"), min_support=0.03, min_confidence=0.3)
    assert {a: round(c, 9) for a, c in got} == {a: round(c, 9) for a, c in want.items()} and len(want) > 3


def test_odd_urls(spark):
    urls = ["http://a.net/" + "x/" * 20_000 + "?" + "&".join(f"k{i}=1" for i in range(2000)), "plain text", "", None, "http://", "://", "http://bad.net/p/1", "http://bad.net/p/1"]
    frame = spark.createDataFrame([(k % 7, u, "h") for k, u in enumerate(urls)] + [(100 + k, f"http://bad.net/p/{k}", "x") for k in range(40)] + [(200 + k, f"http://fine.net/q/{k}", "x") for k in range(40)], "page_id long, url string, tokens string")
    labels = spark.createDataFrame([(100 + k, 0, 0) for k in range(40)] + [(200 + k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    rows = urlrules.judge_urls(frame, labels).collect()
    assert len(rows) == frame.count()
    assert {r.verdict for r in rows if r.host == "bad.net"} == {"block"} and {r.verdict for r in rows if r.host != "bad.net"} == {"allow"}
    tokens = frame.select(urlrules.url_tokens(F.lit(""), F.lit(""), F.col("url")).alias("t"), "url").collect()
    assert all(not r.t for r in tokens if r.url is None or "://" not in r.url)


def test_implied_rules_against_brute_force(spark):
    r = np.random.default_rng(5)
    rules = {tuple(sorted(r.choice(list("abcdef"), r.integers(1, 4), replace=False).tolist())): float(r.integers(5, 10)) / 10 for _ in range(60)}
    want = {a: c for a, c in rules.items() if not any(set(b) < set(a) and d >= c for b, d in rules.items())}
    got = urlrules.without_implied(spark.createDataFrame([*rules.items()], "antecedent array<string>, confidence double")).collect()
    assert {tuple(x.antecedent): x.confidence for x in got} == want and len(got) == len(want) < len(rules)


# WARC -----------------------------------------------------------------------------


def test_archives_round_trip(spark):
    big = "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" + "é" * 200
    pages = [(k, f"http://h{k % 5}.org/p{k}", big if k % 3 == 0 else f"<p>{k}</p>" if k % 3 == 1 else "short") for k in range(60)]
    pages += [(100, None, big), (101, "u\r\nX: y", None), (102, "http://e", ""), (None, "http://n", big), (0, "http://h0.org/p0", big)]
    frame = spark.createDataFrame([(*p, "d", 1) for p in pages], "page_id long, url string, html string, payload_digest string, key int").repartition(4)
    merged = warc.archive_and_merge(frame)
    rows = merged.collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=repr)
    want = []
    for page, _, html in pages:
        data = (html or "").encode()
        later = len(data) >= 100 and page != 0
        want.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if later else "response", 0 if later else None))
    assert got == sorted(want, key=repr)
    order = [(r.key, r.stamp, r.page_id is not None, r.page_id or 0) for r in rows]
    assert order == sorted(order)
    assert warc.archive_and_merge(frame.limit(0)).count() == 0


def test_archives_of_all_sizes(spark, tmp_path):
    """Size classes, offsets, several ranges and archives, one URL with a third of all captures."""
    pages = [(k, "http://hot.org/x" if k % 3 == 0 else f"http://h{k % 11}.org/{k}", "<p>" + chr(65 + k % 26) * (k * 7 % 400)) for k in range(900)]
    pages += [(2000, "http://l.org/1", "é" * 3000), (2001, "http://l.org/2", "z" * 40_000), (2002, "http://l.org/3", "é" * 3000)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    path = str(tmp_path / "warc")
    warc.write_archives(frame, path, ((2000, 50), (10_000, 2), (None, 1)))
    index = warc.read_index(spark, path).cache()
    files = {r.archive for r in index.collect()}
    assert {f.split("/")[0] for f in files} == {"size-0", "size-1", "size-2"} and len(files) > 18
    rows = warc.merge_runs(index, 100).collect()
    order = [(r.key, r.stamp, r.page_id) for r in rows]
    assert order == sorted(order) and len(order) == len(pages)
    html = {k: h.encode() for k, _, h in pages}
    for r in rows[::50] + [r for r in rows if r.page_id >= 2000]:
        with open(f"{path}/{r.archive}", "rb") as file:
            headers, block = warc.record_at(file.read(), r.offset)
        assert headers["WARC-Record-ID"] == f"<urn:page:{r.page_id}>"
        assert r.record_type == "revisit" or block.endswith(html[r.page_id])
        assert r.payload_digest == hashlib.sha256(html[r.page_id]).hexdigest()


def test_runs_whatever_their_job_id(spark, tmp_path):
    """The random id of the writing job is in the archives' names, and "-c" and a digit may be in it."""
    frame = spark.createDataFrame([(k, f"http://h.org/{k:03d}", f"<p>{k}</p>") for k in range(60)], "page_id long, url string, html string").coalesce(1)
    for job in ("721d5048-86bd-477a-989a-c6a955eef2d6", "c21d5048-86bd-477a-989a-f6a955eef2d6", "721d5048-c6bd-477a-989a-f6a955eef2d6"):
        path = tmp_path / job
        warc.write_archives(frame, str(path), ((None, 7),))
        archives = list(path.glob("size-0/*.gz"))
        for archive in archives:
            archive.rename(archive.with_name(re.sub(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", job, archive.name)))
        merged = warc.merge_runs(warc.read_index(spark, str(path)), 1000).collect()
        assert [r.page_id for r in merged] == list(range(60))
        assert len(archives) == 9 and {job in r.archive for r in merged} == {True}


def test_dates_in_a_zone_that_skips_an_hour(spark):
    """On 31 March 2024 Berlin had no time from 2:00 to 3:00; captures before, in and after it."""
    first = int(datetime(2024, 3, 31, 1, tzinfo=timezone.utc).timestamp())
    frame = spark.createDataFrame([(first + 60 * k - warc.EPOCH, "http://h.org/x", "x") for k in range(180)], "page_id long, url string, html string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        stamps = [r.stamp for r in warc.archive_and_merge(frame).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert stamps == [datetime.fromtimestamp(first + 60 * k, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ") for k in range(180)]


def test_loser_tree():
    r = np.random.default_rng(3)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(r.integers(0, 50, r.integers(0, 20)).tolist()) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for run in runs for x in run)


# Quality --------------------------------------------------------------------------


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams: dict = {}
    for k in range(len(words) - 4):
        grams.setdefault(tuple(words[k : k + 5]), []).append(k)
    covered = {p + d for at in grams.values() if len(at) > 1 for p in at for d in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_quality_base_and_rules(spark, odd_documents):
    texts = ["a b c d e f g h i j " * 3, prose(1) * 2, prose(2) + "\n\n" + prose(2), "a a a a a a a a a a a a", "x %%% y $$$ " * 9 + prose(3), prose(4).upper() + "!!", "\u00a0".join("ab" * 9)]
    frame = odd_documents.select("doc_id", "text").union(spark.createDataFrame([(100 + k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    rows = cascade.judge_quality(frame).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = sorted(repr((r.doc_id, *(r[n] for n in names))) for r in rows)
    assert got == sorted(repr((r.doc_id, *brute_quality(r.text))) for r in frame.collect())
    kept = {r.doc_id: r.kept for r in rows}
    assert kept[1] and not kept[104] and not kept[105] and not kept[2]
    assert cascade.judge_quality(frame.limit(0)).count() == 0


def test_cascade_order_is_rejection_per_cost_and_changes_nothing(spark, odd_documents):
    assert cascade.cascade_order({"a": (1.0, 0.1), "b": (0.1, 0.1), "c": (1.0, 0.5)}) == ["b", "c", "a"]
    rules, frame = cascade.default_rules(), cascade.measured(odd_documents.select("doc_id", "text"))
    answers = [sorted(map(repr, frame.select("doc_id", cascade.rejected(rules, order).alias("r")).collect())) for order in (sorted(rules), sorted(rules, reverse=True))]
    assert answers[0] == answers[1]


def test_slow_rules_come_after_free_ones(spark):
    """Two rules that reject the same texts: the one that reads finished columns comes first."""
    frame = spark.createDataFrame([(k, prose(k, 1500)) for k in range(60)], "doc_id long, text string")
    sample = cascade.measured(frame).cache()
    same = F.col("doc_id") % 2 == 0
    rules = {"a_slow": same & (F.size(F.regexp_extract_all("text", F.lit(r"(\w+)\W+(\w+)"), F.lit(0))) > 0), "b_free": same & (F.col("n_words") > 0)}
    found = cascade.measure_rules(sample, rules)
    assert found["a_slow"][1] == found["b_free"][1] == 0.5 and found["a_slow"][0] > 2 * found["b_free"][0]
    assert cascade.cascade_order(found) == ["b_free", "a_slow"]
    assert cascade.measure_rules(sample.limit(0), rules)["a_slow"][1] == 0.0
    sample.unpersist()


# Personal data --------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        total = sum(x - 9 * (x > 9) for x in (int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


def secrets(n):
    return [(k, f"{prose(k, 12)} password={hashlib.md5(bytes([k])).hexdigest()[:18]} {prose(k + 1, 12)} {4000000000000000 + 37 * k} AKIA{hashlib.md5(bytes([k, 1])).hexdigest()[:16].upper()} ok") for k in range(n)]


def test_base_spans(spark, odd_documents):
    texts = [
        "é a@b.c_d@e.f x@y..z q@w.e.r, 😀 me%1+2@host-1.co.uk.", "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 0000000000000",
        "+1 (309) 555-1438, +44.20.7946.0958 +1 2 +123456789012345678", "4111111111111111@x.y +4111111111111111", "9" * 3000 + " " + "a." * 3000 + "@b",
    ]
    frame = odd_documents.select("doc_id", "text", "node").union(spark.createDataFrame([(200 + k, t, "n") for k, t in enumerate(texts)], "doc_id long, text string, node string"))
    rows = pii.find_personal_data(frame).collect()
    want = sorted(repr((r.doc_id, hashlib.sha256(",".join(brute_spans(r.text)).encode()).hexdigest())) for r in frame.collect())
    assert sorted(repr((r.doc_id, r.base_sha256)) for r in rows) == want
    by_id = {r.doc_id: r for r in rows}
    assert by_id[200].n_email == sum(x.startswith("email") for x in brute_spans(texts[0]))
    assert pii.find_personal_data(frame.limit(0)).count() == 0


def test_secrets_are_learnt_and_redacted(spark):
    frame = spark.createDataFrame([(k, t, len(t), "c") for k, t in secrets(60)] + [(99, None, None, None)], "doc_id long, text string, n_chars long, _base string")
    rows = {r.doc_id: r for r in pii.find_personal_data(frame).collect()}
    hits = sum(x.count("secret:") for x in (r.spans for r in rows.values()))
    assert hits >= 110
    out = {r.doc_id: r for r in pii.redact(frame).collect()}
    assert pii.redact(frame).columns == frame.columns
    for k, text in secrets(60):
        for x in filter(None, rows[k].spans.split(",")):
            _, a, b = x.split(":")
            assert text[int(a) : int(b)] not in out[k].text
        assert out[k].n_chars == len(out[k].text)
    assert out[99].text is None


def test_secrets_behind_a_hot_source(spark):
    hot = [(k, f"order {hashlib.md5(bytes([k % 250, k // 250])).hexdigest()} of {hashlib.sha1(bytes([k % 250, k // 250])).hexdigest()}") for k in range(3000)]
    found = secrets(60)
    frame = spark.createDataFrame([*hot, *[(10_000 + k, t) for k, t in found]], "doc_id long, text string").coalesce(1)
    rows = {r.doc_id: r.spans for r in pii.find_personal_data(frame).collect()}
    assert sum(rows[10_000 + k].count("secret:") for k, _ in found) >= 110
    assert not any("secret:" in rows[k] for k, _ in hot)


def test_secrets_of_one_class_alone(spark):
    frame = spark.createDataFrame([(k, f"password={hashlib.md5(bytes([k])).hexdigest()[:18]}.") for k in range(20)], "doc_id long, text string")
    assert pii.teach(pii.proposed(frame).where("label = 1")) is None
    assert all("secret:" in r.spans for r in pii.find_personal_data(frame).collect())


def test_trees_find_what_the_teacher_does_not(spark):
    """Keys assigned to names the teacher does not know, in the format of those it knows."""
    key = lambda k: hashlib.sha1(bytes([k % 256, k // 256])).hexdigest()
    texts = {k: f'{prose(k, 12)} token = "{key(k)}" {prose(k + 1, 9)}' for k in range(150)}
    texts |= {500 + k: f"{prose(k, 12)} build {key(500 + k)[:24]} of {prose(k + 1, 9)}" for k in range(150)}
    texts |= {900 + k: f'{prose(k, 12)} clave = "{key(900 + k)}" {prose(k + 1, 9)}' for k in range(7)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r.doc_id: r.spans for r in pii.find_personal_data(frame, precision=0.9).collect()}

    def right(k):
        text, own = texts[k], key(k)
        return f"secret:{text.index(own)}:{text.index(own) + 40}" in rows[k].split(",")

    assert all(right(k) for k in range(150))
    assert sum(right(900 + k) for k in range(7)) == 7
    assert sum("secret" in rows[500 + k] for k in range(150)) == 0


def test_other_kinds(spark):
    texts = [
        "pay DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432 now", "not DE88 3704 0044 0532 0130 00 either",
        "write ann.b [at] example [dot] co [dot] uk soon", "look at it and dot the rest", "key eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0.c2lnbmF0dXJlMTIz end",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: [x.split(":") for x in r.spans.split(",") if x] for r in pii.find_personal_data(frame).collect()}
    found = {k: [(x[0], texts[k][int(x[1]) : int(x[2])]) for x in own] for k, own in rows.items()}
    assert found[0] == [("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432")]
    assert not [x for x in found[1] + found[3] if x[0] in ("iban", "address")]
    assert found[2] == [("address", "ann.b [at] example [dot] co [dot] uk")]
    assert found[4] == [("secret", "eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0.c2lnbmF0dXJlMTIz")]


def test_very_many_matches(spark):
    text = " ".join(f"u{k}@é.org 10.0.{k % 256}.1" for k in range(6000))
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.find_personal_data(frame).first()
    assert (row.n_email, row.n_ip) == (sum(x.startswith("email") for x in brute_spans(text)), 6000)
    assert row.base_sha256 == hashlib.sha256(",".join(brute_spans(text)).encode()).hexdigest()
    assert pii.redact(frame).first().text.count("<IP>") == 6000


# Decontamination ------------------------------------------------------------------


def test_contamination(spark, odd_documents):
    items = [(k, prose(k + 50, 30).lower() if k == 2 else prose(k + 50, 30)) for k in range(8)] + [(20, "Maria has 12 apples and 7 km to walk so how many km did she walk per apple today"), (21, "too short"), (22, None), (23, ""), (20, "A repeated id with quite other words inside of this one item here")]
    benchmark = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, window int")
    texts = {
        300: f"{prose(1)} {items[0][1]} {prose(2)}",
        301: prose(3),
        302: "so. It is said that Nora has 95 apples and 31 miles to walk so how many miles did she walk per apple today. Yes.",
        303: f"{' '.join(items[3][1].split()[:16])} {prose(4)}",
        304: f"{' '.join(items[4][1].split()[5:12])} {prose(4)}",
        305: items[2][1].upper(),
    }
    frame = odd_documents.select("doc_id", "text", "node", "score").union(spark.createDataFrame([(k, t, "n", "s") for k, t in texts.items()], "doc_id long, text string, node string, score string"))
    got = {r.doc_id: r for r in decontam.judge_documents(frame, benchmark).collect() if r.doc_id is not None}
    assert {k for k, r in got.items() if r.contaminated} == {300, 302, 303, 305}
    assert got[300].items == "0" and got[302].items == "20"
    kept = decontam.drop_contaminated(frame, benchmark)
    assert kept.columns == frame.columns and kept.count() == frame.count() - 4
    assert decontam.judge_documents(frame.limit(0), benchmark).count() == 0
    assert not decontam.judge_documents(frame, benchmark.limit(0)).where("contaminated").count()


def test_short_items_inside_long_documents(spark):
    items = [(1, "Seven grey owls sing"), (2, "Pluto."), (3, "4711"), (4, "Who? Nora Vance")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    texts = {
        1: f"{prose(1)} Seven grey owls sing. {prose(2)}",
        2: f"{prose(3)} so seven grey owls sing. {prose(4)}",
        3: f"{prose(5)}\nPluto\n{prose(6)}",
        4: f"{prose(7)} 4711. {prose(8)}",
        5: f"{prose(9)} 4712. {prose(10)}",
        6: "9999",
        7: f"{prose(11)} Who? Nora Brandt",
        8: "Seven grey owls sing now. Pluto is far",
        9: prose(12, 200_000) + " Seven grey owls sing.",
        10: prose(13),
    }
    frame = spark.createDataFrame([*texts.items(), (None, texts[1])], "doc_id long, text string")
    got = {r.doc_id: r.items for r in decontam.judge_documents(frame, benchmark).collect()}
    assert got == {1: "1", 2: "", 3: "2", 4: "3", 5: "", 6: "3", 7: "4", 8: "", 9: "1", 10: "", None: "1"}


def test_templates_do_not_depend_on_pieces():
    text = (prose(3, 400) + " Then - Anna ran 5 km. Bert saw * 7 min? New York 12,5 % of Ulm\nRome 3 s.").replace(" am", " 9 m") * 3
    column = pa.array([text])
    whole = list(decontam._row_templates(column))[0][2:5]
    for size in (16, 64, 300):
        parts = list(decontam._row_templates(column, size))
        assert len(parts) == 1 and all((a == b).all() for a, b in zip(whole, parts[0][2:5])), size


def plain_templates(text):
    """Template and value of each word, by plain loops; values that a sentence start forbids stay."""
    edge, out, begins, gap = ".,;:!?\"'()[]{}<>*_", [], True, ""
    for m in re.finditer(r"([^\x20\x09-\x0D]+)([\x20\x09-\x0D]*)", text):
        whole, start = m[1], begins or "\n" in gap
        word = whole.strip(edge)
        begins, gap = whole[-1] in ".!?:" or (start and not word), m[2]
        if not word:
            continue
        low = word.lower()
        number = re.fullmatch(r"[0-9.,/:+-]*[0-9][0-9.,/:+-]*", word) is not None
        after = bool(out) and out[-1][0] == "<n>"
        unit = low in decontam.UNITS or after and low in decontam.UNITS_AFTER_NUMBERS
        name = re.match("[A-ZÀ-ÖØ-Þ]", word) and re.search("[a-zß-ÿ]", word) and not start
        out.append(("<n>" if number else "<u>" if unit else "<p>" if name else low, low))
    return out


def plain_matches(texts, items):
    """(document, item) pairs by enumeration of all alignments."""
    size, marks, found = decontam.WINDOW, {"<n>", "<u>", "<p>"}, set()
    coded = {k: plain_templates(t) for k, t in items.items()}
    windows = {}
    for k, words in coded.items():
        own = [i for i in range(len(words) - size + 1)]
        literal = [i for i in own if any(t not in marks for t, _ in words[i : i + size])]
        for i in literal or own:
            windows.setdefault(tuple(t for t, _ in words[i : i + size]), []).append((k, i, len(literal or own)))
    for d, text in texts.items():
        words, aligned = plain_templates(text), {}
        for at in range(len(words) - size + 1):
            for k, i, n in windows.get(tuple(t for t, _ in words[at : at + size]), ()):
                slots = [(b[1], a[1]) for a, b in zip(words[at : at + size], coded[k][i : i + size]) if a[0] in marks]
                aligned.setdefault((k, n, at - i), []).append((i, slots))
        places = {}
        for (k, n, _), own in aligned.items():
            votes = {}
            for _, slots in own:
                for a, b in slots:
                    votes.setdefault(a, {}).setdefault(b, 0)
                    votes[a][b] += 1
            best = {a: max(v, key=lambda b: (v[b], b == a, hash64(b))) for a, v in votes.items()}
            places.setdefault((k, n), set()).update(i for i, slots in own if all(best[a] == b for a, b in slots))
        for (k, n), own in places.items():
            run = best_run = 0
            for i in range(max(own, default=-1) + 1):
                run = run + 1 if i in own else 0
                best_run = max(best_run, run)
            if len(own) >= decontam.COVERAGE * n or best_run >= decontam.PASSAGE_WORDS - size + 1:
                found.add((d, k))
    return found


def hash64(word):
    data = np.frombuffer(word.encode(), np.uint8)
    return int(textkit.word_hashes(data)[0].view(np.int64)[0])


def test_matches_equal_brute_force(spark):
    """All documents and items of a table, with planted changes of the items."""
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text")
    items = {r.item_id: r.text for r in benchmark.collect() if r.text}
    planted = {}
    for n, (k, text) in enumerate(sorted(items.items())[:40]):
        words = text.split()
        words[len(words) // 2] = "altered" if n % 2 else "7"
        planted[10_000 + n] = f"{prose(n)} {' '.join(words[n % 3 :])} {prose(n + 500)}"
    questions = {9001: "A train leaves Ulm at 9 and runs 80 km to Bonn in 2 hours , how fast is it on average then ?"}
    planted |= {11_000: "Well. A train leaves Graz at 7 and runs 60 km to Linz in 3 hours , how fast is it on average then ?"}
    planted |= {11_001: "Well. A train leaves Graz at 7 and sails 60 km to Linz in 3 hours , how slow is it on average now ?"}
    documents = documents.unionByName(spark.createDataFrame(list(planted.items()), "doc_id long, text string"))
    benchmark = benchmark.unionByName(spark.createDataFrame(list(questions.items()), "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in decontam.find_contamination(documents, benchmark).collect()}
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    assert got == plain_matches(texts, items | questions)
    assert (11_000, 9001) in got and (11_001, 9001) not in got and len(got) > 20


def test_slots_must_agree(spark):
    item = "In May Anna bought 5 pens and Anna sold 5 pens to Bert before Anna lost 5 more pens"
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    same = item.replace("Anna", "Olga").replace("5", "8")
    mixed = "In May Anna bought 5 pens and Rita sold 6 pens to Bert before Gerd lost 7 more pens"
    frame = spark.createDataFrame([(1, same), (2, mixed)], "doc_id long, text string")
    assert {r.doc_id: r.contaminated for r in decontam.judge_documents(frame, benchmark).collect()} == {1: True, 2: False}


def test_one_differing_slot_spares_the_other_windows(spark):
    item = f"In May Anna paid 5 crowns {prose(70, 12).lower()} then 5 crowns {prose(71, 12).lower()} and Anna had 5 left"
    sums = "What do you get when you add 5 to 5 " + prose(72, 14).lower()
    benchmark = spark.createDataFrame([(1, item), (2, sums)], "item_id long, text string")
    texts = {
        1: item.replace("then 5", "then 6"),
        2: item.replace("and Anna", "and Rita"),
        3: item.replace("5", "8").replace("then 8", "then 6").replace("Anna", "Olga"),
        4: sums.replace("5 to 5", "3 to 4"),
        5: " ".join(w if k % 5 else "gap" for k, w in enumerate(item.split())),
    }
    frame = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.items for r in decontam.judge_documents(frame, benchmark).collect()}
    assert got == {1: "1", 2: "1", 3: "1", 4: "2", 5: ""}
    pair = decontam.find_contamination(frame.where("doc_id = 1"), benchmark).collect()[0]
    assert pair.n_windows == pair.item_windows - 5 and not pair.reworded


# Toxicity -------------------------------------------------------------------------


def test_deobfuscation_and_scores(spark):
    rude = ["moron", "scum"]
    rows = [(k, f"{prose(k, 30)} {rude[k % 2] if k % 3 == 0 else 'friend'} {prose(k + 1, 30)}") for k in range(400)]
    hidden = [(1000, f"{prose(1)} what a m0r0n you are"), (1001, f"{prose(2)} s c u m all of it"), (1002, f"{prose(3)} mooooron"), (1003, prose(4)), (1004, None), (1005, ""), (None, f"{prose(9)} scum")]
    frame = spark.createDataFrame([(*r, "x", 1.0) for r in rows + hidden], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(400)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(frame, labels).collect()}
    assert all(got[k].predicted == int(k % 3 == 0) for k in range(400))
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in range(400))
    assert [got[k].predicted for k in (1000, 1001, 1002, 1003, 1004, 1005, None)] == [1, 1, 1, 0, 0, 0, 1]
    kept = toxicity.reject_toxic(frame, labels)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.where("doc_id >= 1000").collect()) == [1003, 1004, 1005]


def test_short_toxic_words(spark):
    rude = ["zq", "vub", "wojk"]
    rows = [(k, f"{prose(k, 30)} {rude[k // 3 % 3] if k % 3 == 0 else 'pal'} {prose(k + 1, 30)}") for k in range(400)]
    apart = [(1000 + k, f"{prose(k)} you {w} {prose(k + 9)}") for k, w in enumerate(rude)]
    parts = [(1010, f"{prose(1)} zqa vubs avub wojkan"), (1011, f"{prose(2)} v0b vuuuub {prose(3)}")]
    frame = spark.createDataFrame(rows + apart + parts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(400)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(frame, labels).collect()}
    assert all(got[k] == int(k % 3 == 0) for k in range(400))
    assert [got[1000 + k] for k in range(3)] == [1, 1, 1]
    assert (got[1010], got[1011]) == (0, 1)


def test_windows_do_not_depend_on_pieces():
    decoder = toxicity.Decoder(np.log(np.full((27,) * 4, 1 / 27)))
    text = (prose(4, 150) + " you are a s t u p i d m o r o n and an 1d10t , " + "a " * 40).encode()
    data = np.frombuffer(text, np.uint8)

    def keys(block_bytes):
        found = []
        for own, inner in toxicity._parts(data, np.array([0, len(data)]), 0, 1, block_bytes):
            (g, _), (word, _), (begin, _), (first, last, _) = toxicity.windows(own, inner, decoder)
            found.append(np.concatenate([g, first, last, -word, -toxicity.HASHED - begin]))
        return len(found), set(np.concatenate(found).tolist())

    assert keys(1 << 20)[0] == 1 and keys(64)[0] > 5
    assert keys(64)[1] == keys(1 << 20)[1] == keys(200)[1]


def test_large_window_table_is_whole(spark):
    letters = np.random.default_rng(1).integers(97, 123, (12_000, 8)).astype(np.uint8)
    words = [w for w in (x.tobytes().decode() for x in letters) if not re.search(r"(.)\1\1", w)]  # others are restored
    frame = spark.createDataFrame([(k, " ".join(words)) for k in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, 1) for k in range(20)], "doc_id long, quality int, toxic int")
    known, weights = toxicity.feature_table(toxicity.training_rows(frame, labels)[0], toxicity.language_model(frame))
    want = {f" {w} "[k : k + 5] for w in words for k in range(6)}
    assert (known < toxicity.CELLS5).sum() == len(want) > 50_000 and len(known) == len(weights) and (weights >= 0.5).all()
    own = known[(known >= toxicity.CELLS5) & (known < toxicity.CELLS5 + toxicity.HASHED)]
    assert len(words) - len(own) < 50  # words that share a cell


def test_held_out_quality(spark):
    """Recall, precision and order of scores on rows that were not learnt from, on whole tables."""
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score_toxicity(documents, labels).where("held_out")
    rows = scored.join(labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").toPandas()
    bad, found, rank = rows.toxic == 1, rows.predicted == 1, rows.score.rank()
    auc = (rank[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())
    assert found[bad].mean() >= 0.8 and bad[found].mean() >= 0.97 and auc >= 0.95


def test_letters_of_other_scripts():
    def word(text):
        return toxicity.letters(text)

    assert word("Ĕÿ") == "ey" and word("сор") == "cop" and word("e\u0301t\u0308") == "et" and word("日本") != "" and word("…€") == ""
    data = "日本 жук x".encode()
    codes, rows = toxicity.fold(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert "".join("x" if c else " " for c in codes[rows == 0]) == " xx xxx x "


def test_best_cut():
    clean, toxic = np.zeros(101), np.zeros(101)
    clean[[0, 30, 40]], toxic[[0, 60, 80]] = [50, 5, 5], [1, 5, 5]
    assert toxicity.best_cut(clean, toxic) == 0.4575  # a quarter of the way from 0.41 to 0.60
    assert toxicity.best_cut(clean, 0 * toxic) == 0.5


def test_the_cut_comes_from_all_training_rows(spark, monkeypatch):
    """More rows than the 20,000 that a sample once had; the counts of all reach the cut."""
    frame = spark.range(30_000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'wretch', 'friend') AS text")
    marks = frame.selectExpr("doc_id", "1 AS quality", "int(doc_id % 3 = 0) AS toxic")
    seen, cut = [], toxicity.best_cut
    monkeypatch.setattr(toxicity, "best_cut", lambda clean, toxic: seen.append((clean.sum(), toxic.sum())) or cut(clean, toxic))
    toxicity.score_toxicity(frame, marks)
    want = marks.where(~toxicity.held_out(F.col("doc_id"))).groupBy().agg(F.count_if(F.col("toxic") == 0), F.sum("toxic")).first()
    assert seen == [tuple(want)] and sum(want) > 20_000


def test_scores_of_odd_rows(odd_documents, labels):
    rows = toxicity.score_toxicity(odd_documents, labels).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.score == 0 for r in rows if r.doc_id in (2, 3, 4)) and len({r.score for r in rows if r.doc_id == 0}) == 1
    assert not any(r.held_out for r in rows if r.doc_id is None)
    assert toxicity.score_toxicity(odd_documents.limit(0), labels).count() == 0
    assert toxicity.score_toxicity(odd_documents, labels.limit(0)).where("predicted = 1").count() == 0
