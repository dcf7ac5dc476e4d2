"""Large rule sets: candidates by one pattern a field, equal to every rule by itself."""

import random
import re
import time

from pyspark.sql import functions as F

from tests.conftest import events_df
from vigil.operators.detect import rule_hits
from vigil.operators.prefilter import NEVER, UNKNOWN, Needs, longest_word_pattern, needs_of
from vigil.operators.rules import load_rule

WORDS = ["fail", "failed", "ail", "FAILED login", "a.b", "a+b", "(x)", "é", "ß", "\U0001F600", "tab\there", "new\nline", "[", "log", "login", "in"]


def rule(i, **detection):
    return load_rule({"title": f"r{i}", "id": f"r{i}", "detection": detection})


def pairs(df):
    return sorted((r["id"], r["rule_ord"]) for r in df.select("id", "rule_ord").collect())


def test_longest_word_at_every_place():
    r = random.Random(3)
    words = {"".join(r.choices("ab.", k=r.randint(1, 5))) for _ in range(40)}
    pattern = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), f"(?=({longest_word_pattern(words)}))"))
    text = "".join(r.choices("ab.c", k=500))
    got = {m.start(): m[1] for m in pattern.finditer(text)}
    want = {i: max((w for w in words if text.startswith(w, i)), key=len, default=None) for i in range(len(text))}
    assert got == {i: w for i, w in want.items() if w}


def test_needs_are_read_off_conditions():
    a, b = {"message|contains": "Long Text"}, {"user|startswith": ["x1", "y2"]}
    need = lambda **d: needs_of(rule(0, **d))
    text, user = Needs(frozenset({("message", "long text")})), Needs(frozenset({("user", "x1"), ("user", "y2")}))
    assert need(selection=a) == text and need(selection={**a, **b}) == text and need(selection=b) == user
    assert need(selection=a, selection_b=b, condition="selection or selection_b") == text | user
    assert need(selection=a, selection_b=b, condition="all of selection*") == text
    assert need(selection=a, selection_b=b, condition="1 of selection*") == text | user
    assert need(selection=a, filter=b, condition="selection and not filter") == text
    assert need(selection=a, condition="selection or nosuch") == text and need(selection=a, condition="nosuch") == NEVER
    for unknown in ({"condition": "not selection"}, {"condition": "0 of selection*"}, {"selection": {"message|re": "x"}}, {"selection": {"message": ["", "x"]}},
                    {"selection": {}}, {"condition": 7}):
        assert need(**{"selection": a, **unknown}) == UNKNOWN
    assert need(selection={"message": []}) == NEVER


def test_random_rules_fire_as_one_by_one(spark):
    r = random.Random(5)

    def block():
        out = {}
        for _ in range(r.randint(1, 2)):
            name = r.choice(["message", "hostname", "user", "nosuch", "severity"]) + r.choice(["", "|contains", "|startswith", "|endswith", "|re", "|odd"])
            out[name] = r.choice(WORDS[:4] + ["log"]) if name.endswith("|re") else r.choice([r.choice(WORDS), r.sample(WORDS, 3), "", []])
        return out

    conditions = ["selection", "selection_a or selection", "all of selection*", "1 of selection*", "2 of selection*", "0 of x*", "3 of selection*",
                  "selection and not selection_a", "not selection", "nosuch or selection", "selection selection_a", "selection or not nosuch"]
    rules = [rule(i, selection=block(), selection_a=block(), condition=r.choice(conditions)) for i in range(150)]
    rules.append(rule(150, selection=block(), threshold={"value": 1}, timeframe="60s"))
    events = events_df(spark, [{"message": "".join(r.choices(WORDS + [" ", "x"], k=r.randint(0, 6))), "hostname": r.choice(WORDS),
                                "parsed_fields": r.choice([{}, {"user": r.choice(WORDS)}, {"user": None}])} for _ in range(120)]).cache()
    together = pairs(rule_hits(events, rules, group=8))
    assert together == pairs(rule_hits(events, rules, group=10_000)) and len(together) > 500
    assert rule_hits(events, rules, group=8)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0


def test_two_thousand_rules_in_one_pass(spark):
    r = random.Random(8)
    words = [f"k{i:x}{'z' * (i % 3)}" for i in range(2000)]
    rules = [rule(i, selection={"message|contains": w}) for i, w in enumerate(words)]
    texts = [" ".join(r.choices([*words, "and", "so"], k=12)) for _ in range(300)]
    hits = rule_hits(events_df(spark, [{"message": t} for t in texts]), rules)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    start = time.time()
    got = pairs(hits)
    assert got == sorted((f"e{e:04d}", i) for e, t in enumerate(texts) for i, w in enumerate(words) if w in t)
    assert "Exchange" not in plan and time.time() - start < 120
    assert hits.where(F.col("match_count").isNotNull()).isEmpty()
