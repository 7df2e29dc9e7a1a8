import hashlib
import itertools
import random
import time
from collections import defaultdict

import pytest

from threadshelf.llm import repair
from threadshelf.llm.repair import ASSISTANT, DELETED, FINE, OTHER, SYSTEM, TRUNCATED, USER, Costs, cheapest_edits, code

SCHEMA = "conv_id long, turn long, role string, text string"


def allowed(roles):
    rest = roles[1:] if roles[:1] == "s" else roles
    return roles == "" or (len(rest) >= 2 and len(rest) % 2 == 0 and all(r == "ua"[i % 2] for i, r in enumerate(rest)))


def every_repair(codes, costs, insertions):
    """All (cost, audit) of edits with at most so many insertions that give allowed roles."""
    found = []
    names = "sua?"
    choices = []
    for one in codes:
        role, fault = divmod(one, 3)
        price = costs.truncated if fault == TRUNCATED else 0
        options = [("D", costs.delete, "")]
        if fault != DELETED:
            options += [("K", price, names[role]), ("R", price + costs.rerole, "u"), ("R", price + costs.rerole, "a")]
        choices.append(options)
    slots = range(len(codes) + 1)
    for picked in itertools.product(*choices):
        for n in range(insertions + 1):
            for where in itertools.combinations_with_replacement(slots, n):
                for said in itertools.product("ua", repeat=n):
                    roles, audit, cost = "", "", n * costs.insert
                    for i in slots:
                        for w, r in zip(where, said):
                            if w == i:
                                roles, audit = roles + r, audit + "I"
                        if i < len(codes):
                            roles, audit, cost = roles + picked[i][2], audit + picked[i][0], cost + picked[i][1]
                    if allowed(roles):
                        found.append((cost, audit))
    return found


@pytest.mark.parametrize("costs", [Costs(), Costs(2, 3, 1, 4), Costs(1, 1, 1, 0), Costs(3, 7, 2, 1)])
def test_cheapest_edits_against_all_repairs(costs):
    rng = random.Random(5)
    for n in range(5):
        for _ in range(12 if n < 4 else 5):
            codes = bytes(code(rng.choice((SYSTEM, USER, ASSISTANT, OTHER)), rng.choice((FINE, FINE, TRUNCATED, DELETED))) for _ in range(n))
            assert cheapest_edits(codes, costs) == min(every_repair(codes, costs, 2 if n > 3 else 3)), (codes, costs)


def test_insertions_are_made_where_they_are_cheap():
    codes = bytes(code(r, FINE) for r in (USER, USER, ASSISTANT))
    assert cheapest_edits(codes, Costs(rerole=9, delete=9, insert=1)) == (1, "KIKK")
    with pytest.raises(ValueError):
        cheapest_edits(codes, Costs(insert=0))


@pytest.mark.parametrize("kinds", [(USER,), (USER, ASSISTANT, ASSISTANT, USER), (SYSTEM, USER, ASSISTANT, OTHER)])
def test_long_conversations_take_linear_time(kinds):
    rng = random.Random(1)
    taken = []
    for n in (10_000, 40_000):
        codes = bytes(code(kinds[i % len(kinds)], rng.choice((FINE, FINE, TRUNCATED, DELETED))) for i in range(n))
        start = time.process_time()
        cost, audit = cheapest_edits(codes)
        taken.append(time.process_time() - start)
        assert len(audit) >= n and cost > 0
    assert taken[1] < 10 * taken[0] + 1


def ended(text):
    return text.rstrip(" \t\n\x0b\f\r")


def model(rows):
    """Reports by conversation, straight from the rules; edits from the search tested above."""
    by_conv = defaultdict(list)
    for row in rows:
        by_conv[row[0]].append(row)
    out = {}
    for conv, members in by_conv.items():
        members = [(turn, " " if role is None else role, " " if text is None else text) for _, turn, role, text in members]
        members.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1], hashlib.md5(m[2].encode()).digest()))
        seen, codes, counts, illegal = set(), [], dict(blank=0, duplicate=0, truncated=0), 0
        for i, (_, role, text) in enumerate(members):
            number = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(role[:1], OTHER)
            fault = FINE
            if not ended(text):
                counts["blank"] += 1
                fault = DELETED
            elif (role, text) in seen:
                counts["duplicate"] += 1
                fault = DELETED
            elif ended(text)[-1] not in ".!?":
                counts["truncated"] += 1
                fault = TRUNCATED
            seen.add((role, text))
            codes.append(code(number, fault))
            illegal += i > 0 and members[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        turns = [t for t, _, _ in members if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = cheapest_edits(bytes(codes))
        said, i = [], 0
        for edit in audit:
            first = bool(said) and said[0][0][:1] == "s"
            chosen = "user" if (len(said) - first) % 2 == 0 else "assistant"
            if edit == "I":
                said.append((chosen, ""))
                continue
            _, role, text = members[i]
            i += 1
            if edit != "D":
                said.append((role if edit == "K" else chosen, text))
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, said)
    return out


def run(spark, rows, extra=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        df = df.selectExpr("*", "'x' AS n", "1 AS text_key", "'y' AS audit", "0 AS kind", "7 AS fault")
    mended = repair.Repair(df)
    texts = defaultdict(list)
    for r in mended.repaired().orderBy("conv_id", "place").collect():
        texts[r.conv_id].append((r.role, r.text))
    report = {r[0]: (*r[1:], texts[r[0]]) for r in mended.report().collect()}
    digests = {r[0]: r[1] for r in mended.digests().collect()}
    for conv, row in report.items():
        assert digests[conv] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in row[-1]).encode()).hexdigest()
    return report


def random_rows(seed):
    rng = random.Random(seed)
    texts = ["Hi.", "So?", "cut", " \t", "", None, "Yes! \n", "é🙂", "x\x0b.", " "]
    roles = ["user", "assistant", "system", "tool", "", None, "usher"]
    rows = []
    for conv in [None, *range(40)]:
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, rng.choice((turn, turn, turn, turn * 3, None)), rng.choice(roles[: rng.choice((2, 3, 7))]), rng.choice(texts)))
            if rng.random() < 0.2:
                rows.append(rows[-1])
    return rows


@pytest.mark.parametrize("extra", [False, True])
def test_conversations_against_the_rules(spark, extra):
    rows = random_rows(3 + extra)
    assert run(spark, rows, extra) == model(rows)


def test_long_texts_and_long_conversations(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"{i} " + "word " * 20 + ".") for i in range(3000)]
    rows += [(2, 0, "user", "a" * 3_000_000), (2, 1, "assistant", "b" * 3_000_000 + "!")]
    assert run(spark, rows) == model(rows)


def test_no_rows(spark):
    assert run(spark, []) == {}


def test_conversations_that_lose_all_rows_stay(spark):
    dropped = next(i for i in range(1000) if __import__("zlib").crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(dropped, 0, "user", "Hi.")], SCHEMA)
    (row,) = repair.repair_damaged(df).collect()
    assert (row.cost, row.audit, row.gaps, row.repaired_sha256) == (0, "", 0, hashlib.sha256(b"").hexdigest())
