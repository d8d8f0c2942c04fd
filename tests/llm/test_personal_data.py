import hashlib
import random
import re

from srcatlas.llm import personal_data as pd_

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p[-300:]) <= 255 and not p[:-300].strip("0") for p in m[0].split(".")) if kind == "ip" else False,
                  "card": 13 <= len(digits) <= 19 and pd_.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def texts():
    rng = random.Random(3)
    parts = ["a@b.c", "@", ".", "+", "1", "255", "256", "4111111111111111", "4111-1111 1111 1111", " ", "-", "(", ")", "é", "x.y", "+1 (505) 555-0101", "1.2.3.4", "٣", "http://", "a", "IBAN "]
    for _ in range(1500):
        yield "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
    for _ in range(800):
        yield "".join(rng.choice("a1@.+- 25") for _ in range(rng.randint(0, 40)))
    yield from ["1" * 5000, "a@" * 3000 + "b.c", "1." * 3000, "+1" * 2000, "0" * 5000 + ".1.1.1", "😀a@b.cd 😀"]


def test_base_kinds_equal_the_patterns():
    automaton = pd_._automaton()
    for text in texts():
        got = [f"{k}:{s}:{e}" for k, s, e in pd_.spans_of(text, automaton) if k in PATTERNS]
        assert got == base(text), text[:100]


def test_frame(spark):
    rows = [(1, "mail me: jo@ex.org, see http://ex.org/a. IBAN DE89 3704 0044 0532 0130 00!"), (2, None), (3, ""), (3, ""), (None, "+1 505 555 0101 x")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, spans int")
    got = {(r["doc_id"], r["spans"]): r for r in pd_.report(df).collect()}
    first = next(r for (i, _), r in got.items() if i == 1)
    assert first["spans"] == "email:9:18,url:24:39,account:46:73"
    assert first["base_sha256"] == hashlib.sha256(b"email:9:18").hexdigest() and first["n_email"] == 1
    assert got[2, ""]["n_phone"] == 0 and got[None, "phone:0:15"]["n_phone"] == 1
    out = pd_.masked(pd_.find(df)).orderBy("doc_id").collect()
    assert [r["text"] for r in out] == ["<phone> x", "mail me: <email>, see <url>. IBAN <account>!", None, "", ""]
    assert pd_.report(df.limit(0)).count() == 0
