import hashlib
import random
import re

from pyspark.sql import functions as F

from screenloom.llm.secrets import KINDS, PLACEHOLDERS, candidates, ownership, placed_spans, scan_secrets

BASE = [
    re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    re.compile("AKIA[A-Z0-9]+"),
    re.compile("[0-9a-f]+"),
    re.compile("[A-Za-z0-9+/_=-]+"),
]
LEAST = [6, 20, 24, 20]


def random_looking(v):
    return bool(re.search("[0-9]", v) and re.search("[A-Za-z]", v)) and not any(w in v.lower() for w in PLACEHOLDERS) and len(set(v)) >= 8 and len(set(v)) * 3 >= min(len(v), 48)


def brute(rows, most_owners=3):
    """(id, counts, digest, spans, live) of every (id, source, text), by the definition."""
    found, holders = [], {}
    for i, source, text in rows:
        text, own = text or "", []
        for k, pattern in enumerate(BASE):
            for m in pattern.finditer(text):
                value = m[2] if k == 0 else m[0]
                if len(value) >= LEAST[k] and (k < 3 or random_looking(value)):
                    own.append((m.start(), k, m.end(), value))
        own = sorted(s for s in own if s[1] < 3 or not any(b[1] < 3 and b[0] < s[2] and b[2] > s[0] for b in own))
        found.append((i, own))
        for s in own:
            holders.setdefault(s[3], set()).add(source)
    out = []
    for i, own in found:
        told = [(a, k, b, "copied" if len(holders[v]) >= most_owners else "live" if random_looking(v) else "plain") for a, k, b, v in own]
        told = [t for t in told if t[1] < 3 or t[3] == "live"]
        line = lambda ts: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in ts)
        counts = tuple(sum(t[1] == k for t in told) for k in range(3))
        out.append((i, *counts, hashlib.sha256(line([t for t in told if t[1] < 3]).encode()).hexdigest(), line(told), line([t for t in told if t[3] == "live"])))
    return sorted(out, key=str)


def scanned(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"kind": F.lit("x"), "uid": F.lit(1), "hash": F.lit(None).cast("string")}).repartition(3)
    got = scan_secrets(df, **options).collect()
    return sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans, r.live) for r in got), key=str)


def test_spans_and_verdicts_equal_brute_force(spark):
    rng = random.Random(5)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    b64, hexa = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", "0123456789abcdef"
    shared = [draw(b64, 30), draw(hexa, 40), "AKIA" + draw("ABC0123456789XYZ", 16)]
    pieces = lambda: rng.choice([
        f'PassWord = "{draw(b64, rng.randint(1, 12))}"', f"token:{rng.choice(shared)}", "secret=token: abcdefgh", "api_key", "apikey :='x1'", "AKIA" + draw("AZ09", rng.randint(0, 20)), "AKIAAKIAQ",
        draw(hexa, rng.randint(20, 50)), draw(b64, rng.randint(15, 45)), rng.choice(shared), "é中\U0001f600 ", " ", "\n", "=", "-" * 30, "your_example_key_0123456789", "ſecret=abcdefg", "toKen=abcdefgh",
    ])
    rows = [(rng.choice([None, i]), rng.choice(["a", "b", "c", None]), rng.choice(["", " ", "x"]).join(pieces() for _ in range(rng.randint(0, 9)))) for i in range(250)]
    rows += [(1, "a", None), (2, "a", ""), (3, None, "token=" + "k9Zq" * 3), *rows[:4]]
    for most in (1, 2, 3, 100):
        assert scanned(spark, rows, most_owners=most) == brute(rows, most)


def test_copied_examples_and_live_keys(spark):
    live, copied = "q8Xw2Lr7Zt5Kp1Vn9Bd3", "h4Jm6Qs8Tv2Wy5Zc7Fg1"
    rows = [(i, f"s{i % 5}", f"use {copied} here") for i in range(40)] + [(100, "s1", f"key {live}!"), (101, "s1", f"key {live}")]
    got = {r[0]: r[5] for r in scanned(spark, rows)}
    assert got[100] == "key:4:24" and got[101] == "key:4:24" and {got[i] for i in range(40)} == {""}
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    held = {r.hash: (r.n_repos, r.n_owners) for r in ownership(placed_spans(candidates(df))).collect()}
    assert held == {hashlib.md5(live.encode()).hexdigest(): (2, 1), hashlib.md5(copied.encode()).hexdigest(): (40, 5)}


def test_long_and_empty(spark):
    long = " ".join(f"token={i:08d}" for i in range(20_000))
    rows = [(1, "a", long), (2, "a", "f" * 300_000)]
    assert scanned(spark, rows) == brute(rows)
    assert scanned(spark, []) == []
