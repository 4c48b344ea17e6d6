import random
import re

import pytest
from pyspark.sql import functions as F

from lumenlog.errors import QueryError
from lumenlog.operators.pattern import _pieces, compile_pattern
from lumenlog.operators.tokens import MIN_TOKEN, TOKEN, bounded, tokenize

# Two lines of an application's log and two token samples with known results.
HIT = "2017-10-22 21:55:44,100 [4508] INFO [DataHandler]: WriteVariable Speed/Value = 0.02002258"
MISS = "2017-10-22 21:54:34,515 [3664] INFO [DataHandler]: WriteVariable Position/Value = 1"


def texts(s):
    return [t.text for t in tokenize(s)]


def test_tokens():
    assert texts("FATAL") == ["FATAL"]
    assert texts("{time:time} [*ROLL_CHANGING -> ROLL_COMPLETED") == ["time", "time", "ROLL", "CHANGING", "ROLL", "COMPLETED"]
    assert texts("unicomp6 DataHandler ABCdef aB1c") == ["unicomp", "6", "Data", "Handler", "ABCdef", "a", "B", "1", "c"]


@pytest.mark.parametrize("bad", ["{", "a{b", "{}", "{:number}", "a**b", "{a}{b}", "*{a}", "{a}*b", "*?", "a\\b"])
def test_bad_patterns(bad):
    with pytest.raises(QueryError):
        compile_pattern(bad)


def reference(pattern, line):
    """A plain restatement: literals are taken where they first stand, and nothing is tried twice."""
    pieces, at, out, k = _pieces(pattern), 0, [], 0
    while k < len(pieces):
        kind, text = pieces[k]
        following = pieces[k + 1][1] if k + 1 < len(pieces) and pieces[k + 1][0] == "literal" else None
        if kind == "literal":
            at = line.find(text, at) if k == 0 else (at if line.startswith(text, at) else -1)
            if at < 0:
                return None
            at += len(text)
        elif kind == "any":
            if at >= len(line) and k + 1 < len(pieces):
                return None
            at += 1
        else:
            if following is None:
                if kind == "capture":
                    out.append(line[at:])
            else:
                to = line.find(following, at)
                if to < 0:
                    return None
                if kind == "capture":
                    out.append(line[at:to])
                at = to + len(following)
                k += 1
        k += 1
    return out


def test_patterns_match_a_plain_restatement(spark):
    rng = random.Random(7)
    lines = ["".join(rng.choices("ab1 ", k=rng.randint(0, 9))) for _ in range(60)] + [HIT, MISS, "a\nb", "\\E.x"]
    patterns = ["{timestamp} [*Speed/Value = {speed}", "*", "", "a?", "?b", "{x}", "{x}b", "a*b?", "\\*a", "\\{", "a{x}1*b", "\\\\E"]
    for _ in range(60):
        p = rng.choice(["", "?", "*", "{x}"])
        for _ in range(rng.randint(1, 3)):
            p += "".join(rng.choices("ab1", k=rng.randint(1, 2))) + rng.choice(["", "?", "*", "{y}"])
        patterns.append(p)
    df = spark.createDataFrame([(n, x) for n, x in enumerate(lines)], "n int, line string")
    good, columns = [], []
    for p in patterns:
        try:
            c = compile_pattern(p)
        except QueryError:
            continue
        groups = F.array(*[F.regexp_extract("line", c.regex, k.group) for k in c.captures]) if c.captures else F.array().cast("array<string>")
        columns.append(F.when(F.col("line").rlike(c.regex) if c.regex else F.lit(True), groups).alias(f"p{len(good)}"))
        good.append(p)
    for row in df.select("line", *columns).collect():
        for k, p in enumerate(good):
            assert row[f"p{k}"] == reference(p, row["line"]), (p, row["line"])


def test_token_expressions_in_the_jvm(spark):
    rng = random.Random(3)
    alphabet = "abAB12 _éÉ"
    lines = ["".join(rng.choices(alphabet, k=rng.randint(0, 14))) for _ in range(150)]
    words = sorted({t.text for x in lines for t in tokenize(x)})[:60]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = df.select("line", F.regexp_extract_all("line", F.lit(TOKEN), F.lit(0)).alias("ts"), *[F.col("line").rlike(bounded(w)).alias(f"w{k}") for k, w in enumerate(words)]).collect()
    for row in got:
        assert row["ts"] == texts(row["line"])
        for k, w in enumerate(words):
            assert row[f"w{k}"] == (w in texts(row["line"])), (w, row["line"])


def test_token_tests_of_phrases():
    p = compile_pattern("user {id} logged*in now")
    assert p.needles == ["user", "logged", "now"]
    assert len(p.token_tests) == 2 and ".*" in p.token_tests[0]
    assert all(len(n) >= MIN_TOKEN for n in p.needles)
    assert compile_pattern("- -").needles == []
    assert re.search(r"\.\{1\}", compile_pattern("abc def").token_tests[0])
