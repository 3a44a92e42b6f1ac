"""Queries over small tables of odd rows, against known values."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from umbra.functions.text import fold_for_compare
from umbra.operators import dictionary, near
from umbra.plans import detection, governance, requests

TEXTS = ["Des +1 (826) 555-4081 190.137.223.204 du", "of nt 0054994038693466 the", "+1 (082) 555-4081(212) 555-0123", "212-555-0123@x.de", "x212-555-0123 and 212-555-01234", "+49 (0) 721 123456", None, ""]


@pytest.fixture(scope="module")
def odd_texts(spark, tmp_path_factory):
    sf_dir = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{sf_dir}/documents.parquet")
    return sf_dir


def test_phone_nanp_spans(spark, odd_texts):
    """North American forms only: neither numbers with other prefixes nor groups that follow behind a gap."""
    rows = detection.phone_nanp_spans(spark, odd_texts).orderBy("doc_id", "start").collect()
    assert [(r.doc_id, r.start, r.end, r.value) for r in rows] == [(0, 4, 21, "+1 (826) 555-4081"), (2, 0, 17, "+1 (082) 555-4081"), (2, 17, 31, "(212) 555-0123"), (3, 0, 12, "212-555-0123")]


def test_counts_rollup(spark, odd_texts):
    """Each kind on its own: a number that begins an address counts, other phone forms do not."""
    counts = {(r.source, r.kind): r.n for r in detection.counts_rollup(spark, odd_texts).collect()}
    assert counts == {("s", "IPV4"): 1, ("s", "EMAIL"): 1, ("s", "PHONE"): 4, ("s", "all"): 6, ("all", "all"): 6}


def test_near_hits_shuffle_hits_only(spark, monkeypatch):
    """The runs of the texts are neither joined nor dealt out; the shuffle join, for large dictionaries, finds the same."""
    names = ["large ring", "SAUDI ARABIA", "nation_1", "gear", "Müller Straße", "Republic of Northern Upper Galla"]
    texts = ["Large rinq, ring large; l. ring largering la rge ring", "lareg ring larg ering", "arabia s  saudi ara bia", "eation 1 nation 1 nation10 NATION    1", "gear gaer", "muller strasse STRASSE MÜLER", "Republic of Northern Upper Gala republic of northern uppergalla", None, ""]
    df = spark.createDataFrame([*enumerate(texts), (0, "large ring")], "id int, text string")
    terms = spark.createDataFrame([(n,) for n in names], "term string")
    found = dictionary.near_hits(df, "id", "text", terms, longest=5)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(map(tuple, found.collect()))
    assert (0, "large ring", "large rinq", 1) in got and (0, "large ring", "large ring", 1) in got and (0, "large ring", "largering", 1) in got
    monkeypatch.setattr(dictionary, "BROADCAST_TERMS", 0)
    joined = dictionary.near_hits(df, "id", "text", terms, longest=5).select("id", "term", "token", "n")
    assert got == sorted(map(tuple, joined.collect())) and len({r[1] for r in got}) == len(names)


def test_near_finder_is_exhaustive():
    """Every run compared with every spelling."""
    rng = random.Random(1)
    for _ in range(400):
        letters = rng.choice(["ab", "abc", "abcdé"])
        spellings = [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 4))) for _ in range(4)]
        forms = tuple((f"T{i}", " ".join(map(near.fold, s.split())), len(s) >= 6 and rng.random() < 0.8) for i, s in enumerate(spellings))
        text = ""
        for _ in range(8):
            s = rng.choice(forms)[1]
            i = rng.randrange(len(s))
            text += rng.choice([s, s[:i] + s[i + 1 :], s[:i] + rng.choice(letters + " ") + s[i:], s[:i] + s[i : i + 2][::-1] + s[i + 2 :], s[:i] + rng.choice(letters + " ") + s[i + 1 :], s.upper()]) + rng.choice([" ", ", ", "_", "    ", " -  ", "\n"])
        words, want = list(re.finditer(r"[^\W_]+", text)), {}
        for i in range(len(words)):
            for n in range(1, min(5, len(words) - i) + 1):
                if any(b.start() - a.end() > 3 for a, b in zip(words[i : i + n], words[i + 1 : i + n])):
                    break
                token = " ".join(near.fold(m[0]) for m in words[i : i + n])
                fit = tuple(sorted(t for t, s, edit in forms if token == s or edit and near.within_one(token, s)))
                if fit:
                    want[token] = (want.get(token, (0,))[0] + 1, fit)
        finder = near.Finder(forms, 5, 3)
        assert {t: (n, finder.terms[t]) for t, n in finder.found(text).items()} == want


def test_near_folds_like_the_column(spark):
    words = ["Straße", "ÀÉñÿ", "ΟΔΟΣ", "İx", "a1²½", "中文", "é"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", fold_for_compare(F.col("w")).alias("f")).collect()
    assert {r.w: r.f for r in rows} == {w: near.fold(w) for w in words}


def events(spark, sf_dir, rows):
    """A table of events from (event_id, microseconds since 1970)."""
    rows = [(i, datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=us), 5, "view", 1.0, "{}") for i, us in rows]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(f"{sf_dir}/events.parquet")


def test_quota_rpm_demand(spark, tmp_path):
    """Times are the nearest milliseconds, as in the SQL: 1 and 60,000 are in one window."""
    events(spark, str(tmp_path), [(1, 600), (2, 60_000_400), (3, -500), (4, -499), (5, 1_500), (6, 999_499)])
    got = {r.event_id: r.in_window for r in governance.quota_rpm_demand(spark, str(tmp_path)).collect()}
    assert got == {3: 1, 4: 2, 1: 3, 5: 4, 6: 5, 2: 4}
    assert [r.at_ms for r in governance.records(spark, str(tmp_path)).orderBy("event_id").collect()] == [1, 60_000, -1, 0, 2, 999]


def test_warnings_throttled(spark, tmp_path):
    """A warning half a millisecond before the minute is the first of the next one."""
    events(spark, str(tmp_path), [(17, 10_000_000), (34, 59_999_600), (51, 60_000_000), (68, 59_999_400), (1, 0)])
    assert [tuple(r) for r in requests.warnings_throttled(spark, str(tmp_path)).select("status", "n", "ids").collect()] == [(403, 2, 51)]


def test_warnings_throttled_in_other_session_zones(spark, tmp_path):
    """02:30 and 03:30 of the day on which New York has no 02:30 are two minutes, as in the SQL."""
    events(spark, str(tmp_path), [(17, 1_710_037_800_000_000), (34, 1_710_041_400_000_000), (51, 1_710_041_459_999_499)])
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = [tuple(r) for r in requests.warnings_throttled(spark, str(tmp_path)).select("status", "n", "ids").collect()]
        times = [r.at_ms for r in governance.records(spark, str(tmp_path)).orderBy("event_id").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [(403, 2, 51)]
    assert times == [1_710_037_800_000, 1_710_041_400_000, 1_710_041_459_999]
