import hashlib
import random
import re
import time

from tidemark.llm import pii

#: The base rules, as plain Python.
BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (14 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def texts():
    rnd = random.Random(5)
    bits = ["a@b.com", "_x@y.org", "x@@y.z", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "0255.000.1.001", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "+1", "+", "é", "😀", " ", ".", "-", "12", "0", "x", "\n", "@", "GB82 WEST 1234 5698 7654 32", "123-45-6789", "ssn ", "token ", "a1" * 12]
    made = ["".join(rnd.choices(bits, k=rnd.randint(1, 14))) for _ in range(400)]
    return [None, "", *made, *sorted(NOTHING), "1 " * 60_000, "+1" + "(" * 100_000, "a@b.c " * 16_000, "1.2.3.4 " * 3000, "x" * 700 + "a@b.c" + "é" * 90_000 + "@"]


#: Long runs that plain patterns take quadratic time to give up; by the rules nothing in them counts.
NOTHING = {"x" * 300_000 + "@", "1" * 120_000}


def test_base_spans_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    got = {r["doc_id"]: r for r in pii.digest(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for i, text in rows:
        want = "" if text in NOTHING else brute(text)
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (text or "")[:80]
        assert ",".join(x for x in got[i]["spans"].split(",") if x.split(":")[0] in ("email", "ip", "card", "phone")) == want


def test_added_kinds_and_context(spark):
    df = spark.createDataFrame([(1, "my iban GB82 WEST 1234 5698 7654 32 ok"), (2, "iban GB83 WEST 1234 5698 7654 32"), (3, "ssn 123-45-6789"), (4, "part 123-45-6789")], "doc_id long, text string")
    found = {r["doc_id"]: [(s["kind"], s["text"]) for s in r["spans"]] for r in pii.find_pii(df).collect()}
    assert found[1] == [("iban", "GB82 WEST 1234 5698 7654 32")] and found[2] == [] and found[3] == [("ssn", "123-45-6789")] and found[4] == []
    assert pii.mask_pii(df).where("doc_id = 3").first()["text"] == "ssn <ssn>"


def test_secrets_need_a_form_or_a_word_beside_them(spark):
    hexed, key = "7c72db563d7f6e50cec00950f7bab1f2223b6afd", "AKIA" + "A1B2C3D4" * 2
    texts = [f'token = "{hexed}"', f"commit {hexed}", f"{hexed} is my PASSWORD", f"see {key}.", "token " + "x" * 40, "token " + "1" * 40, "a token of internationalisation2024", "-----BEGIN RSA PRIVATE KEY-----", "Token " + "a1" * 9]
    got = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [[(s["kind"], s["text"]) for s in r["spans"]] for r in sorted(got)] == [
        [("secret", hexed)], [], [("secret", hexed)], [("key", key)], [], [], [("secret", "internationalisation2024")], [("key", "-----BEGIN RSA PRIVATE KEY-----")], []
    ]


def test_time_follows_the_matches(spark):
    took = {}
    for n in (8000, 8000, 32_000):
        df = spark.createDataFrame([(1, "ab@c.de " * n)], "doc_id long, text string")
        begin = time.time()
        assert pii.digest(pii.find_pii(df)).first()["n_email"] == n
        took[n] = time.time() - begin
    assert took[32_000] < 8 * took[8000] + 2


def test_context_counts_on_both_sides_and_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "123-45-6789 is my social number", 1), (2, None, 2), (3, "a@b.co, 123-45-6789", 3)], "doc_id long, text string, spans__cut0 int")
    found = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.find_pii(df).collect()}
    assert found == {1: ["ssn"], 2: [], 3: ["email"]}
    masked = {r["doc_id"]: (r["text"], r["spans__cut0"]) for r in pii.mask_pii(df).collect()}
    assert masked == {1: ("<ssn> is my social number", 1), 2: (None, 2), 3: ("<email>, 123-45-6789", 3)}


def test_empty_table(spark):
    assert pii.digest(pii.find_pii(spark.createDataFrame([], "doc_id long, text string, kind string"))).count() == 0
