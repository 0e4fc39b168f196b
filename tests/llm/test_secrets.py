import hashlib
import random
import re
from math import log2

from paperlake.llm import secrets
from paperlake.llm.queries import QUERIES

from .conftest import SMALL

ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS, HEX, RUN = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+"), re.compile("[A-Za-z0-9+/_=-]{20,}")


def base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(found)


UUID = re.compile("[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


SAMPLE = re.compile(r"^(.{1,4})\1{4,}|(?i:example|sample|dummy|placeholder|x{4,}|abcdefgh|012345678?|12345678)")


def plain_name(run):
    """Words of small letters, or numbers, joined by signs; only slashes before the first."""
    tokens = [t for t in re.split("[/_=-]+", run) if t]
    words = all(t.isdigit() or (t.isalpha() and t.islower()) for t in tokens)
    return bool(tokens) and words and run.lstrip("/")[0] not in "_=-"


def least_bits(w):
    digits, upper, lower = (sum(map(test, w)) for test in (str.isdigit, str.isupper, str.islower))
    if digits >= 2 and upper + lower >= 2:
        return 3.0 if all(c in "0123456789abcdefABCDEF" for c in w) else 3.6
    return 3.9 if upper >= 6 and lower >= 6 else 99


def entropy(text):
    """Windows counted anew each, joined where they touch."""
    out = []
    for m in RUN.finditer(text):
        run = m[0]
        if UUID.fullmatch(run) or plain_name(run):
            continue
        sample = {i for x in SAMPLE.finditer(run) for i in range(x.start(), x.end())}
        spans = []
        for at in range(len(run) - 19):
            w = run[at : at + 20]
            clear = sample.isdisjoint(range(at, at + 20))
            bits = -sum(w.count(c) / 20 * log2(w.count(c) / 20) for c in set(w))
            if bits >= least_bits(w) - 1e-12:
                if spans and at <= spans[-1][1]:
                    spans[-1][1:] = [at + 20, spans[-1][2] or clear]
                else:
                    spans.append([at, at + 20, clear])
        out += [(m.start() + a, 3, m.start() + b) for a, b, clear in spans if clear]
    return out


def shown(spans):
    return ",".join(f"{('assign', 'access', 'hex', 'entropy')[k]}:{s}:{e}" for s, k, e in spans)


def brute(doc_id, text):
    found = base(text or "")
    more = [x for x in entropy(text or "") if not any(b[0] <= x[0] and x[2] <= b[2] for b in found)]
    counts = [sum(k == i for _, k, _ in found) for i in range(3)]
    return (doc_id, *counts, hashlib.sha256(shown(found).encode()).hexdigest(), shown(sorted(found + more)))


def planted(seed):
    draw = random.Random(seed)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    some = lambda of, n: "".join(draw.choice(of) for _ in range(n))
    parts = [
        lambda: "PassWord : '" + some(alphabet, draw.randint(3, 12)) + "'",
        lambda: "token=token=" + some(alphabet, 6),
        lambda: "secret: token: abcdefgh",
        lambda: "AKIA" + some("ABCDEFGH0123", draw.randint(10, 20)),
        lambda: some("0123456789abcdef", draw.randint(20, 45)),
        lambda: some(alphabet, draw.randint(18, 60)),
        lambda: some("ab1", 50),
        lambda: some(alphabet[:52], draw.randint(18, 60)),
        lambda: "/" * draw.randint(0, 2) + "-_=/"[draw.randint(0, 3)] + "some-path_of=19/words-only",
        lambda: "//////////////////////",
        lambda: "123e4567-e89b-12d3-a456-426614174000",
        lambda: "some/path/of/plain/words/index",
        lambda: "é " * draw.randint(0, 30),
        lambda: "word " * draw.randint(0, 9),
    ]
    return "".join(draw.choice(parts)() + draw.choice([" ", "\n", "", "; "]) for _ in range(draw.randint(0, 25)))


def test_against_brute_force(spark):
    docs = [(i, planted(i)) for i in range(60)] + [(100, None), (101, "")]
    rows = secrets.scan(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [brute(*d) for d in docs]
    assert any("entropy" in r.spans for r in rows)


def test_secrets_beside_samples(spark):
    """Samples and repetitions in a run hide nothing but themselves."""
    draw = random.Random(7)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    key = lambda n: "".join(draw.choice(alphabet[:52]) + draw.choice(alphabet[52:]) for _ in range(n // 2))
    before = ["example_conn=", "-----", "=====", "path/sample/", "xxXX", "ab" * 9 + "=", "dummy/abcdefgh-012345678_"]
    planted = [(start, key(40), end) for start in before for end in ("", "/Placeholder", "=12345678")]
    planted += [("", key(200) + "xxxx" + key(200), ""), ("sample" * 500, key(30), "")]
    docs = [(i, f"see {a}{k}{b} there") for i, (a, k, b) in enumerate(planted)]
    rows = secrets.scan(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).orderBy("doc_id").collect()
    for row, (a, k, _) in zip(rows, planted):
        places = [tuple(map(int, span.split(":")[1:])) for span in row.spans.split(",") if span.startswith("entropy")]
        assert any(s <= 4 + len(a) and 4 + len(a) + len(k) <= e for s, e in places), (a, k, row.spans)
    clean = secrets.redact(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert not any(k in row.text for row, (_, k, _) in zip(sorted(clean), planted))
    samples = ["a1B2c3D4e5EXAMPLEf6G7h8", "01234567-k9J8h7G6f5D4", "Dummy/0a9b8c7d6e5f4g3H", "----------a1b2c3d4e5f6g7H8", "x1" * 9 + "q8W7e6R5t4Y3"]
    df = spark.createDataFrame(list(enumerate(samples)), "doc_id long, text string")
    assert [row.spans for row in secrets.scan(df).collect()] == [""] * len(samples)


def test_many_matches_in_one_text(spark):
    text = " ".join(f"token={i:06d}abc" for i in range(2000))
    row = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert tuple(row) == brute(1, text) and row.n_assign == 2000


def test_production_query(spark, small):
    rows = QUERIES["op7_secret_scan"](spark, SMALL).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [brute(*d) for d in sorted(small.itertuples(index=False))]


def test_redact(spark, odd_docs):
    docs = odd_docs.unionByName(odd_docs.limit(1).selectExpr(
        "9L AS doc_id", "'é token = abcdef123, deadbeefdeadbeefdeadbeef01 end' AS text", "lang", "50L AS n_chars",
        "score", "n", "key", "spans",
    ))
    found = secrets.redact(docs)
    assert found.columns == docs.columns and found.count() == docs.count()
    row = found.where("doc_id = 9").first()
    assert row.text == "é [secret], [secret] end" and row.n_chars == len(row.text)
    assert found.where("doc_id <> 9 OR doc_id IS NULL").exceptAll(odd_docs).count() == 0
    assert secrets.scan(docs.limit(0)).count() == 0


def test_no_python_on_the_way(spark):
    plan = QUERIES["op7_secret_scan"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_very_long_runs(spark):
    """Runs on which a pattern with a repeated group would overflow the stack, and long secrets."""
    draw = random.Random(9)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    docs = [(i, "1/a/" * (n // 4)) for i, n in enumerate((4_000, 100_000, 1_000_000))]
    docs += [(10, "".join(draw.choice(alphabet) for _ in range(100_000))), (11, "q" * 1_000_000), (12, "qWeRtY" * 20_000)]
    docs += [(13, "-" * 500_000), (14, "a-" * 200_000 + "1b"), (15, "token=" + "x" * 300_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: r for r in secrets.scan(df).collect()}
    assert [found[i].spans for i in (0, 1, 2, 11, 12, 13, 14)] == [""] * 7
    covered = sum(int(e) - int(s) for s, e in (x.split(":")[1:] for x in found[10].spans.split(",")))
    assert covered >= 99_900 and found[15].n_assign == 1
    clean = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert clean[2] == docs[2][1] and len(clean[10].replace("[secret]", "")) == 100_000 - covered


def test_recall_on_planted_strings(spark):
    """Random strings of 20 to 40 characters, 250 of each alphabet, inside a sentence."""
    draw = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    kinds = {"hex": "0123456789ABCDEF", "letters": letters, "alphanumeric": letters + "0123456789", "base64": letters + "0123456789+/"}
    docs = []
    for kind, alphabet in kinds.items():
        docs += [(kind, f"the value {''.join(draw.choice(alphabet) for _ in range(draw.randint(20, 40)))} was here") for _ in range(250)]
    df = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(docs)], "doc_id long, text string")
    hit = {r.doc_id for r in secrets.scan(df).where("spans <> ''").collect()}
    recall = {kind: sum(docs[i][0] == kind for i in hit) / 250 for kind in kinds}
    print("recall", recall)
    assert min(recall.values()) >= 0.9, recall
    plain = [
        "getElementsByTagNameNamespace", "AbstractSingletonProxyFactoryBean", "INTERNATIONALIZATION_SETTINGS",
        "internationalisation/uncharacteristically", "IncludeAllDayEventsInCalendar", "2024-01-31-some-long-slug-of-words",
    ]
    df = spark.createDataFrame(list(enumerate(plain)), "doc_id long, text string")
    assert secrets.scan(df).where("spans <> ''").count() == 0


def test_scan_keeps_repeated_rows_and_clashing_columns(spark, odd_docs):
    found = secrets.with_spans(odd_docs, "found")
    assert found.columns == [*odd_docs.columns, "found"] and found.count() == odd_docs.count()
    assert found.drop("found").exceptAll(odd_docs).count() == 0
