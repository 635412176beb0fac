"""Secret scans against a plain version, and against their SQL."""

import hashlib
import math
import os
import random
import re
from collections import Counter

import duckdb
from cases import frame, rows as case_rows

import __spark_entry__ as entry
from signalloom.llm import secrets

ASSIGN = re.compile(r"""(?ia:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def plain(text, allow=()):
    """Base spans and all spans of a text, window by window."""
    text = text or ""
    base = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    base += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    told = list(base)
    for k, (kind, chars, held, w, entropy) in enumerate(secrets.CLASSES):
        spans = []
        for m in re.finditer(f"[{chars}]{{{w},}}", text):
            if not all(re.search(h, m[0]) for h in held) or any(re.search(a, m[0]) for a in secrets.ALLOWED) or m[0] in allow:
                continue
            for i in range(len(m[0]) - w + 1):
                counts = Counter(m[0][i : i + w]).values()
                if -sum(n / w * math.log2(n / w) for n in counts) >= entropy / 1000 - 1e-9:
                    a, b = m.start() + i, m.start() + i + w
                    if spans and spans[-1][1] >= a:
                        spans[-1][1] = b
                    else:
                        spans.append([a, b])
        told += [(a, 3 + k, kind, b) for a, b in spans if not any(t[0] <= a and b <= t[3] for t in told)]
    return sorted(base), sorted(told)


def line(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)


def texts():
    rng = random.Random(5)
    of = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    digits, low, up = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    b64, url = low + up + digits + "+/", low + up + digits + "_-"
    out = ["", None, "password=abc", "password=token: abcdefg", "Api_Key : 'abc123' API-KEY=xxxxxxx apikey=yyyyyy", "token=secret=abcdefgh", 'é😀 "PassWord"  :  "hunter2hunter2" Key toKen=abcdefgh']
    out += ["AKIA" + of(up + digits, 16), "AKIAAKIA" + of(up + digits, 10), "xAKIA" + of(up, 30) + "é", of("0123456789abcdef", 23), "é" + of("0123456789abcdef", 64) + "😀", of("0123456789ABCDEF", 32)]
    for n in (23, 24, 25, 40, 600, 1500):
        out += [f"go {of(c, n)} é {of(c, n)}." for c in (b64, url, low + digits, "0123456789abcdefABCDEF")]
    out += ["x" * 5000 + "1aA" + of(b64, 30) + "y" * 2000, of(b64, 511) + "aaaaaaaa" * 80 + of(url, 700), "a1B" * 3000, "thisIsAnExampleKey" + of(b64, 30), "0123456789abcdefghijklmnopqrstuvwxyz"]
    out += ["6F9619FF-8B86-D011-B42D-00CF4FC964FF", "id=6f9619ff-8b86-d011-b42d-00cf4fc964ff", "https://host.example/" + of(low, 40), "a" * 50_000, "some-long-slug-with-words-2024-and-more", of(digits, 60)]
    out += [" ".join(of(b64, rng.randrange(1, 60)) + rng.choice(["", " token=" + of(url, 9)]) for _ in range(700))]
    return out


def test_against_plain_windows(spark):
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts() * 2)], "doc_id long, text string")
    for r in secrets.with_secrets(docs).collect():
        base, told = plain(r["text"])
        assert [tuple(s) for s in r["base"]] == base, r["text"][:80]
        assert [tuple(s) for s in r["found"]] == told, r["text"][:80]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[1] == k for s in base) for k in range(3))


def test_allow_list_names_and_empty_tables(spark):
    one, two = "q8Zr2LmX0vTn5KcW7yBd3HsJ9pFg", "u4Ye6RaQ1oNi8MwC2zVx5TkL7bGh"
    docs = spark.createDataFrame([(1, f"{one} {two}", "x", 5), (None, None, None, None)], "doc_id long, text string, found string, n_hex int")
    got = {r["doc_id"]: r for r in secrets.with_secrets(docs, allow=[one]).collect()}
    assert [tuple(s) for s in got[1]["found"]] == plain(f"{one} {two}", [one])[1] != []
    assert (got[None]["n_hex"], got[None]["found"]) == (0, [])
    assert secrets.with_secrets(docs.limit(0)).count() == 0
    assert len(secrets.with_secrets(frame(spark)).collect()) == len(case_rows())


def connected(folder):
    con = duckdb.connect()
    path = f"{folder}/documents.parquet"
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def test_sql_on_awkward_texts(spark, tmp_path):
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts())], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = secrets.op13_secret_scan(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    found = Counter(tuple(r) for r in got.collect())
    assert found == Counter(connected(tmp_path).execute(secrets.OP13_SQL).fetchall())
    wanted = Counter()
    for i, x in enumerate(texts()):
        base, told = plain(x)
        wanted[(i, *(sum(s[1] == k for s in base) for k in range(3)), hashlib.sha256(line(base).encode()).hexdigest(), line(told))] += 1
    assert found == wanted


def test_query_over_whole_tables(spark):
    folder = "/root/testdata/sf0.001"
    df = entry.queries()["op13_secret_scan"](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert Counter(tuple(r) for r in df.collect()) == Counter(connected(folder).execute(entry.oracle_sql()["op13_secret_scan"]).fetchall())
