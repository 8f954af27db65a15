import hashlib
import re

from cohortlens.llm import pii as P
from cohortlens.llm.queries import LLM_QUERIES

from .conftest import SF, edge_rows

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(d) for d in digits[::-1]]
            luhn = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(doubled)) % 10 == 0
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".") if kind == "ip"),
                  "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


CASES = ["a@b@c.d", "a@b.c@d.e.f-", "x..%@-.-", "@a.b", "a@b", "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.0255", "1.2.3", "0001.2.3.4",
         "4111-1111 1111 1111 4111111111111111", "4111  1111", "+1 (555) 123-4567.", "+12((((", "++44 20 7946 0958", "é a@b.cd 😀 +49 30 123456",
         "4" * 5000, "a" * 5000 + "@", "1." * 5000, "+1" * 3000, "a@" * 3000]


def test_against_plain_patterns(documents, texts):
    for t in [*CASES, *texts.values()]:
        assert [s[:3] for s in P.spans(t) if s[0] in P.BASE_KINDS] == brute(t)
    got = P.find_spans(documents).collect()
    assert {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in got} == {i: [s[:3] for s in P.spans(t)] for i, t in texts.items()}


def test_iban_and_context():
    spans = P.spans("my bank account DE89 3704 0044 0532 0130 00, not DE88 3704 0044 0532 0130 00")
    assert [s[:3] for s in spans if s[0] == "iban"] == [("iban", 16, 43)]
    near, far = P.spans("call +49 30 1234567")[-1][3], P.spans("xxxx +49 30 1234567")[-1][3]
    assert near > far
    assert P.redact("mail a@b.cd now", P.spans("mail a@b.cd now")) == "mail [email] now"


def test_edges(edge, empty):
    got = P.find_spans(edge).collect()
    assert len(got) == len(edge_rows())
    kinds = next([s["kind"] for s in r["spans"]] for r in got if r["doc_id"] == 16)
    assert {"email", "ip", "card", "phone", "iban"} <= set(kinds)
    assert all(r["spans"] == [] for r in got if r["doc_id"] in (1, 2, 3))
    assert P.find_spans(empty).collect() == []


def test_secrets():
    found = lambda t: [t[s[1]:s[2]] for s in P.spans(t) if s[0] == "secret"]
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    for text in (f'token = "{key}" x', f"TOKEN: {key}", f"api_key='{key}'", f'"password": "{key}"', f"my secret={key}."):
        assert [x.rstrip(".") for x in found(text)] == [key], text
    for text in ('token = "correcthorsebattery"', "token = 111111111111", "token = aaaa1aaaa1aaaa", f"the number {key}", f"broken={key}", "password: short1"):
        assert found(text) == [], text
    near, far = (P.spans(f"{w} token = {key}")[-1][3] for w in ("secret login", "some other"))
    assert near > far
    assert found("token=" + "ab1" * 100_000) == [] and found("token=" * 50_000) == []


def test_registered_query(spark):
    sf = SF.replace("0.001", "0.01")  # the smallest table holds no secret
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in LLM_QUERIES["op4_pii"](spark, sf).collect()}
    assert got.keys() == texts.keys()
    planted = 0
    for i, t in texts.items():
        base, every, r = brute(t), P.spans(t), got[i]
        join = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert [r[f"n_{k}"] for k in P.BASE_KINDS] == [sum(s[0] == k for s in base) for k in P.BASE_KINDS]
        assert r["base_sha256"] == hashlib.sha256(join(base).encode()).hexdigest()
        assert r["spans"] == join([s[:3] for s in every]) and r["spans"].startswith(join(base))
        assert r["scores"] == ",".join(f"{s[3]:.2f}" for s in every)
        hidden = re.findall(r'token = "([0-9a-f]{40})"', t)
        planted += len(hidden)
        assert r["n_secret"] >= len(hidden)
    assert planted
