import hashlib
import re

from corpusloom.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, m.end(), kind))
    return sorted(out)


TEXTS = [
    None, "", "no data", "a@b.c_d@e.f x", "x..y%+-@z.co.uk@more.org", "1.2.3.4.5.6.7.8 and 256.1.1.1 and 0001.2.3.004",
    "4111 1111 1111 1111 and 4111111111111112, 4111-1111-1111-1111-9", "+1 (555) 123-4567 +4915112345678901234 +12 34",
    "é😀 mail é@a.b x@é.com ü1@b-c.de😀 +33 1 23 45 67 89!", "5" * 5000 + " " + "1 " * 4000 + "a" * 5000 + "@b.c" + "1." * 3000,
    "pay to IBAN DE89 3704 0044 0532 0130 00 now", "IBAN DE89 3704 0044 0532 0130 01", "ssn 123-45-6789" + " x" * 40 + " 987-65-4321",
    "call (555) 123-4567 please", "visa card 4222222222222 ok", "a@b.c" * 3, "1.1.1.1" * 4, "12-34 56-78 90-12 34-56 7",
]


def test_base_equals_brute_force(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, start string")
    got = {r.doc_id: [tuple(s) for s in r.base] for r in pii.find_pii(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_ips_with_parts_of_zeros(spark):
    texts = ["10.0.0.1 and 127.0.0.1, 192.168.0.1", "0.0.0.0", "1.00.2.3 000.0000.00.0", "0.0.0.256 00256.1.1.1 0.0.0.1000", "0" * 4000 + ".0.0.1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.base] for r in pii.find_pii(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    assert [len(got[i]) for i in range(5)] == [3, 1, 2, 0, 1]


def test_added_spans(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r.doc_id: [s.kind for s in r["all"]] for r in pii.find_pii(df).collect()}
    assert got[10] == ["iban"] and got[11] == [] and got[12] == ["ssn"] and got[13] == ["local"] and got[14] == ["oldcard"]


def test_secrets(spark):
    token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = [f'the token = "{token}" stays', f"no word before {token}", "token " + "ab" * 20, "key: " + "a1" * 20, "token " + "x" * 5000 + " " + "_" * 5000, "api key AbC0/dEf+GhIjKlMnOpQrStUvWxYz12==", None, "", f"{token}@mail.com is a key"]
    got = {r.doc_id: [tuple(s) for s in r["all"]] for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    kinds = {i: [s[3] for s in found] for i, found in got.items()}
    assert kinds == {0: ["secret"], 1: [], 2: [], 3: [], 4: [], 5: ["secret"], 6: [], 7: [], 8: ["email"]}
    assert got[0][0][0] == 13 and got[0][0][2] == 13 + len(token)


def test_query_digest(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in pii.op10_pii(spark, str(tmp_path)).collect():
        base = brute(TEXTS[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert r.has_pii == bool(r.spans) and r.n_spans == len([x for x in r.spans.split(",") if x])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[3] == k for s in base) for k in PATTERNS)


def test_empty_table(spark):
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0
