import random
import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from trafficlens.functions import clock, derive, render
from trafficlens.functions.clf import parse_clf, section
from trafficlens.sources.text_log import line_parser

GOOD = '127.0.0.1 - miguel [02/Nov/2020:10:00:00 +0100] "HEAD /joined HTTP/1.0" 200 999'
TIME = datetime(2020, 11, 2, 9)


def parse(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    return [r.asDict() for r in parse_clf(df).orderBy("i").collect()]


def request(text):
    return GOOD.replace("HEAD /joined HTTP/1.0", text)


def test_good_line(spark):
    (row,) = parse(spark, [GOOD])
    assert row["reject_reason"] is None
    assert (row["host"], row["ident"], row["auth_user"]) == ("127.0.0.1", "-", "miguel")
    assert row["ts"] == TIME
    assert (row["method"], row["resource"], row["version"]) == ("HEAD", "/joined", "1.0")
    assert (row["status"], row["bytes"], row["section"]) == (200, 999, None)


CASES = [
    # line, reason
    (GOOD, None),
    (GOOD.replace(" 999", ""), "structure"),
    (GOOD.replace("- ", "", 1), "structure"),
    (GOOD.replace("02/Nov/2020:10:00:00 +0100", "02/Nov/2020:10 +0100"), "datetime"),
    (request("HEAD /joined HTTP"), "request"),
    (request("GET / HTTP/1.0"), None),
    (request("HEAD /scripts HTTP/1.0"), None),
    (request("POST /scripts/start HTTP/1.0"), None),
    (request("PUT /images/banana.gif HTTP/1.0"), None),
    (request("DELETE /images/holidays/palm_tree.gif HTTP/1.0"), None),
    (request("OPTIONS /config HTTP/1.0"), None),
    (request("/index.html HTTP/1.0"), "request"),
    (request("GET HTTP/1.0"), "request"),
    (request("GET //"), "request"),
    (request("SAUSAGE /index.html HTTP/1.0"), "request"),
    (request("GET /index.html HTTP/1.0 badum-tss"), "request"),
    (request("GET / HTTP/1x1"), None),
    (request("GET / HTTP/2"), "request"),
    (request("get / HTTP/1.0"), "request"),
    (request("GET /a\tb HTTP/1.0"), "request"),
    (request("GET / HTTP/1.0\r"), None),
    (request("GET  / HTTP/1.0"), "request"),
    (GOOD[:-3] + "-", "bytes"),
    (GOOD[:-3] + "+7", None),
    (GOOD[:-3] + "-7", None),
    (GOOD[:-3] + "\t7", "bytes"),
    (GOOD[:-3] + "9223372036854775808", "bytes"),
    (GOOD.replace(" 200 ", " abc "), "status"),
    (GOOD.replace(" 200 ", " 2147483648 "), "status"),
    (GOOD.replace(" 200 ", "  "), "status"),
    (GOOD + " ", None),
    (GOOD + "  ", "structure"),
    (GOOD + " x", "structure"),
    (GOOD[:-3] + " ", "bytes"),
    (GOOD[:-3], "structure"),
    (GOOD.replace("127.0.0.1 ", "127.0.0.1  ").replace("- ", "", 1), None),
    (GOOD.replace("] ", "]x"), None),
    (GOOD.replace('" 200', '"x200'), None),
    (GOOD.replace("]", ""), "structure"),
    (GOOD.replace("[", ""), "structure"),
    (GOOD.replace("miguel ", "miguel\t"), "structure"),
    ("", "structure"),
    ("\r", "structure"),
    ("garbage", "structure"),
    ("\n".join("a - b 1/1/2020:0:0:0_+0000 GET /x 1.0 200 5".split()), "structure"),
]


def test_cases(spark):
    got = [r["reject_reason"] for r in parse(spark, [line for line, _ in CASES])]
    assert list(zip([c[0] for c in CASES], got)) == CASES


DATETIMES = {
    "02/Nov/2020:10:00:00 +0100": TIME,
    "02/November/2020:10:00:00 +0100": TIME,
    "02/11/2020:10:00:00 +0100": TIME,
    "2/11/2020:9:0:0 +0000": TIME,
    "02/nov/2020:09:00:00 -0000": TIME,
    "02/May/2020:10:30:00 +0130": datetime(2020, 5, 2, 9),
    "29/Feb/2020:23:59:59 -0130": datetime(2020, 3, 1, 1, 29, 59),
    "29/Feb/2021:00:00:00 +0000": None,
    "32/13/2020:00:00:00 +0000": None,
    "01/13/2020:00:00:00 +0000": None,
    "00/01/2020:00:00:00 +0000": None,
    "02/Nox/2020:10:00:00 +0100": None,
    "02/Novem/2020:10:00:00 +0100": None,
    "02/Nov/2020:24:00:00 +0100": None,
    "02/Nov/2020:10:60:00 +0100": None,
    "02/Nov/2020:10:00:60 +0100": None,
    "02/Nov/2020:10:00:00 +0160": None,
    "02/Nov/2020:10:00:00": None,
    "02/Nov/2020:10:00:00 +0100 ": None,
    "02-Nov-2020:10:00:00 +0100": None,
    "02/Nov/20:10:00:00 +0100": None,
    "": None,
}


def test_datetimes(spark):
    df = spark.createDataFrame(list(enumerate(DATETIMES)), "i int, text string")
    rows = df.select("i", "text", clock.parse_datetime("text").alias("ts")).orderBy("i").collect()
    assert {r["text"]: r["ts"] for r in rows} == DATETIMES


def test_all_month_names(spark):
    names = [datetime(2020, m, 1).strftime(f) for m in range(1, 13) for f in ("%b", "%B", "%m")]
    df = spark.createDataFrame([(f"01/{n}/2020:00:00:00 +0000",) for n in names], "text string")
    got = [r[0].month for r in df.select(clock.parse_datetime("text")).collect()]
    assert got == [m for m in range(1, 13) for _ in range(3)]


def test_display(spark):
    df = spark.sql("select timestamp_millis(1604311200000) ts")
    row = df.select(clock.format_datetime(F.col("ts")), clock.display_datetime(F.col("ts"))).first()
    assert tuple(row) == ("02/11/2020:10:00:00 +0000", "02/11/2020:10:00:00 +0000 (1604311200000)")


PATTERN = re.compile(r'([^ ]*) ([^ ]*) ([^ ]*) \[([^\]]*)\].\"([^\"]*)\".([^ ]*) (?:([^ ]+) ?| )\Z', re.S)
REQUEST = re.compile(r"(?:GET|HEAD|POST|PUT|PATCH|DELETE|OPTIONS) \S+ HTTP/[0-9].[0-9]$")
ALPHABET = ' "[]/-:+019aNovGETHP\t'


def expected_reason(line):
    m = PATTERN.match(line)
    if not m:
        return "structure"
    for form in ("%d/%m/%Y:%H:%M:%S %z", "%d/%b/%Y:%H:%M:%S %z", "%d/%B/%Y:%H:%M:%S %z"):
        try:
            moment = datetime.strptime(m[4], form)
            break
        except ValueError:
            moment = None
    if moment is None:
        return "datetime"
    if not REQUEST.match(m[5]):
        return "request"
    for text, bits, why in ((m[6], 31, "status"), (m[7] or "", 63, "bytes")):
        if not re.fullmatch("[+-]?[0-9]+", text) or not -(2**bits) <= int(text) < 2**bits:
            return why
    return None


def test_mutated_lines_agree_with_an_independent_check(spark):
    rng = random.Random(7)
    lines = []
    for _ in range(4000):
        text = list(GOOD if rng.random() < 0.5 else request("POST /a/b/c.html HTTP/1.1"))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(text))
            change = rng.random()
            if change < 0.4:
                text[at] = rng.choice(ALPHABET)
            elif change < 0.7:
                del text[at]
            else:
                text.insert(at, rng.choice(ALPHABET))
        lines.append("".join(text))
    got = [r["reject_reason"] for r in parse(spark, lines)]
    # The independent date check is looser on blanks, so differing dates are told apart by hand.
    wrong = [(line, g, expected_reason(line)) for line, g in zip(lines, got) if g != expected_reason(line)]
    assert all(g == "datetime" for _, g, _ in wrong), wrong[:5]
    assert len(wrong) < 40
    assert len({g for g in got}) == 6


def test_canonical_and_pattern_ways_agree(spark):
    """A trailing blank sends the same line through the pattern."""
    lines = [request(f"{m} /x/{i} HTTP/{v}") for i, m in enumerate(["GET", "PUT", "PATCH"]) for v in ("1.0", "2.0")]
    fast, slow = parse(spark, lines), parse(spark, [line + " " for line in lines])
    for a, b in zip(fast, slow):
        a.pop("line"), b.pop("line")
        assert a == b


@pytest.mark.parametrize(
    "resource, expected",
    [("/report", None), ("/wp-content/x", "/wp-content"), ("//x", "/"), ("a/b/c", "/b"), ("abc", None), ("/a/", "/a")],
)
def test_section(spark, resource, expected):
    assert spark.createDataFrame([(resource,)], "resource string").select(section()).first()[0] == expected


def test_status_category(spark):
    values = [99, 100, 199, 200, 299, 300, 399, 400, 499, 500, 599, 600, -1]
    df = spark.createDataFrame([(v,) for v in values], "status int")
    got = [r[0] for r in df.select(derive.status_category(F.col("status"))).collect()]
    names = ["InformationResponse", "Success", "Redirection", "ClientError", "ServerError"]
    assert got == ["OutOfRange", *[n for n in names for _ in range(2)], "OutOfRange", "OutOfRange"]


def test_human_size(spark):
    cases = {
        0.0: "0.00B", 1023.0: "1023.00B", 1024.0: "1.00KB", 5270.0: "5.15KB", 17506.0: "17.10KB",
        1024.0**2: "1.00MB", 1024.0**3 * 1.5: "1.50GB", 1024.0**4: "1.00TB", 1024.0**5 * 3: "3.00PB",
        1024.0**6: "1024.00PB",
    }
    df = spark.createDataFrame([(v,) for v in cases], "size double")
    got = {r[0]: r[1] for r in df.select("size", render.human_size(F.col("size"))).collect()}
    assert got == cases


def test_render_parses_back(spark):
    (row,) = parse(spark, [GOOD])
    df = parse_clf(spark.createDataFrame([(GOOD,)], "line string"))
    line = df.select(render.clf_line()).first()[0]
    assert line == '127.0.0.1 - miguel [02/11/2020:09:00:00 +0000] "HEAD /joined HTTP/1.0" 200 999'
    (again,) = parse(spark, [line])
    row.pop("line"), again.pop("line")
    assert row == again


def test_custom_format(spark):
    parser = line_parser(
        lambda line: F.struct(
            F.timestamp_seconds(F.split_part(line, F.lit(","), F.lit(1)).try_cast("long")).alias("ts"),
            F.split_part(line, F.lit(","), F.lit(2)).alias("what"),
        )
    )
    df = parser(spark.createDataFrame([("60,a",), ("x,b",)], "line string")).orderBy("line")
    good, bad = df.collect()
    assert (good["ts"], good["what"], good["reject_reason"]) == (datetime(1970, 1, 1, 0, 1), "a", None)
    assert (bad["ts"], bad["reject_reason"]) == (None, "format")
    with pytest.raises(ValueError):
        line_parser(lambda line: F.struct(line.alias("text")))(spark.createDataFrame([("x",)], "line string"))


def test_parsing_runs_once_and_without_python(spark):
    df = parse_clf(spark.createDataFrame([(GOOD,)], "line string"))
    plan = df.where("reject_reason is null and status > 1")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace") == 1
    assert "Python" not in plan


def test_offsets_shift_to_utc(spark):
    when = datetime(2020, 11, 2, 10, tzinfo=timezone(timedelta(hours=-5)))
    df = spark.createDataFrame([(when.strftime("%d/%b/%Y:%H:%M:%S %z"),)], "text string")
    assert df.select(clock.parse_datetime("text")).first()[0] == datetime(2020, 11, 2, 15)
