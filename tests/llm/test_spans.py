"""Secret scan and personal data against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest

from attestor.llm import pii, secrets
from attestor.session import table

from .rows import edge_rows, edges


def luhn(d: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


SECRETS = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
}
PRIVATE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m[0])) <= 15),
}


def base(kinds: dict, text: str | None) -> tuple:
    found, n = [], []
    for order, (name, (pattern, ok)) in enumerate(kinds.items()):
        hits = [m for m in re.finditer(pattern, text or "") if ok(m)]
        n.append(len(hits))
        found += [(m.start(), order, name, m.end()) for m in hits]
    said = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))
    return *n, hashlib.sha256(said.encode()).hexdigest(), said


@pytest.mark.parametrize(("module", "kinds"), [(secrets, SECRETS), (pii, PRIVATE)], ids=["secrets", "pii"])
@pytest.mark.parametrize("which", ["edges", "clashing", "table"])
def test_base_spans(spark, module, kinds, which):
    docs = table(spark, "/root/testdata/sf0.001", "documents") if which == "table" else edges(spark, which == "clashing")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = module.report(docs).collect()
    names = ["doc_id", *[f"n_{k}" for k in kinds], "base_sha256"]
    assert Counter(tuple(r[c] for c in names) for r in got) == Counter((i, *base(kinds, t)[:-1]) for i, t in rows)
    expected = Counter()
    for i, t in rows:
        expected[i, base(kinds, t)[-1]] += 1
    shown = Counter((r["doc_id"], ",".join(s for s in r["spans"].split(",") if s.split(":")[0] in kinds)) for r in got)
    assert shown == expected  # the base spans stay among all spans


def test_weak_parts_need_a_partner(spark):
    far = " filler" * 100
    rows = [(1, "user: bob"), (2, "user: bob password=abcdefgh1"), (3, f"user: bob{far} password=abcdefgh1"), (4, "see https://a.b/c"), (5, "https://a.b/c user: bob secret=abcdefgh1")]
    got = {r["doc_id"]: r["spans"] for r in secrets.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    kinds = {i: [s.split(":")[0] for s in spans.split(",") if s] for i, spans in got.items()}
    assert kinds == {1: [], 2: ["account", "assign"], 3: ["assign"], 4: [], 5: ["endpoint", "account", "assign"]}


def test_credentials(spark):
    """Each secret with the nearest parts within the scope, against all pairs in plain Python."""
    far = " filler" * 100
    rows = [
        (1, "user: bob password=abcdefgh1 https://a.b/c"), (2, f"login=amy{far} secret=abcdefgh2"), (3, f"user: bob token=abcdefgh3{far} account: eve api_key=abcdefgh4 postgres://db/x"),
        (4, None), (5, "AKIA" + "B" * 16 + " user: joe password=abcdefgh5 user: sue"), (6, "password=abcdefgh6"), (6, "password=abcdefgh6 login=max"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["credentials"]) for r in secrets.report(docs).collect())
    expected = Counter()
    for i, text in rows:
        all_spans = {r["spans"] for r in secrets.report(spark.createDataFrame([(i, text)], docs.schema)).collect()}.pop()
        parts = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in all_spans.split(",") if s)]
        group, last, groups = 0, None, {}
        for p in sorted(parts, key=lambda p: p[1]):
            group += last is None or p[1] - last > secrets.SCOPE
            groups[p], last = group, p[1]
        near = lambda s, kinds: min((p for p in parts if p[0] in kinds and abs(p[1] - s[1]) <= secrets.SCOPE), key=lambda p: (abs(p[1] - s[1]), p[1] > s[1], -p[1]), default=None)  # noqa: B023, E731
        shown = lambda p: ":".join(map(str, p)) if p else ""
        out = []
        for s in (p for p in parts if p[0] in secrets._SECRETS):
            a, e = near(s, secrets._IDENTIFIERS), near(s, ("endpoint",))
            if a or e:
                out.append("|".join((str(groups[s]), shown(a), shown(s), shown(e))))
        expected[i, ";".join(out)] += 1
    assert got == expected and sum(n for (_, c), n in got.items() if c) >= 4
    found = secrets.credentials(docs).collect()
    assert len(found) == sum(c.count(";") + 1 for _, c in got.elements() if c)


def test_checksums_and_context(spark):
    rows = [(1, "GB82 WEST 1234 5698 7654 32"), (2, "GB83 WEST 1234 5698 7654 32"), (3, "call 555-123-4567"), (4, "size 555-123-4567"), (5, "my ssn 078-05-1120")]
    got = {r["doc_id"]: r["spans"].split(":")[0] for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: k for i, k in got.items() if i != 2} == {1: "iban", 3: "local", 4: "", 5: "ssn"}
    assert "iban" not in got[2]


def test_context_reaches_past_other_matches(spark):
    many = ", ".join(f"555-{i}-4567" for i in range(200, 208))
    rows = [(1, "Phone: 555-123-4567, 555-987-6543 for details"), (2, "078-05-1120, 219-09-9999, 457-55-5462: social security"), (3, f"call {many}"), (4, "555-123-4567, 555-987-6543")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.report(docs).collect()}
    starts = {i: [int(s.split(":")[1]) for s in spans.split(",") if s] for i, spans in got.items()}
    # 'call' begins the text; the number at 61 no longer sees it within 48 code points
    assert starts == {1: [7, 21], 2: [0, 13, 26], 3: [5, 19, 33, 47], 4: []}
    redacted = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert redacted[1] == "Phone: [PHONE], [PHONE] for details" and redacted[2] == "[SSN], [SSN], [SSN]: social security"
    assert redacted[3].count("[PHONE]") == len(starts[3]) and redacted[4] == rows[3][1]


def test_account_numbers_among_other_words(spark):
    de, gb, no = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO9386011117947"
    texts = {
        f"IBAN {de} BIC COBADEFFXXX": [de], f"{gb} USD 500.00": [gb], f"{de} {gb} {no}": [de, gb, no], f"AB12 CDEF {gb} and": [gb],
        f"XX {de} Xy, {no}.": [de, no], f"{gb}x": [], f"{no}1": [], f"X{no}": [], f"{gb[:-1]}3 USD": [], f"AB12 34 {no} {no} 1 2 3": [no, no], "A" * 9000 + f" {no}": [no],
        "AB12 CDEF " * 300 + gb: [gb],
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"].split(",") for r in pii.report(docs).collect()}
    redacted = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    for i, (text, accounts) in enumerate(texts.items()):
        spans = [s.split(":") for s in got[i] if s.startswith("iban")]
        assert [text[int(s) : int(e)] for _, s, e in spans] == accounts
        if accounts:
            assert redacted[i].count("[IBAN]") == len(accounts) and not any(a in redacted[i] for a in accounts)


COUNTRY = {c: n for n, codes in pii.LENGTHS.items() for c in codes.split()}


def is_account(hit: str) -> bool:
    bare = hit.replace(" ", "")
    if not re.match("[A-Z]{2}[0-9]{2}", hit) or not 15 <= len(bare) <= 34:
        return False
    turned = bare[4:] + bare[:4]
    return int("".join(str(ord(c) - 55) if c.isalpha() else c for c in turned)) % 97 == 1


def added(text: str) -> list[str]:
    """The spans beside the base kinds, by plain loops."""
    out = []
    run = r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11})[A-Z0-9]++(?![a-z])(?:\x20[A-Z0-9]++(?![a-z]))*+"
    for m in re.finditer(run, text):
        words, i, at = m.group().split(" "), 0, m.start()
        while i < len(words):
            hits = [(COUNTRY.get(words[i][:2]) == len("".join(words[i : i + n])), n) for n in range(1, len(words) - i + 1) if n <= 34 and is_account(" ".join(words[i : i + n]))]
            n = max(hits)[1] if hits else 1
            size = len(" ".join(words[i : i + n]))
            if hits:
                out.append((at, 4, f"iban:{at}:{at + size}"))
            at, i = at + size + 1, i + n
    for kind, order, pattern in (("local", 5, r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"), ("ssn", 6, r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")):
        for m in re.finditer(pattern, text):
            near = text[max(0, m.start() - 48) : m.start()] + " " + text[m.end() : m.end() + 48]
            if re.search(rf"(?i)(?<![a-z])(?:{pii.WORDS[kind]})", near):
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


@pytest.mark.parametrize("which", ["edges", "table", "made"])
def test_added_spans(spark, which):
    """Account numbers, and numbers that nearby words speak for, against plain loops."""
    docs = edges(spark) if which == "edges" else table(spark, "/root/testdata/sf0.01", "documents")
    if which == "made":
        rng = random.Random(17)
        parts = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "NO9386011117947", "AB12", "USD 500", "call", "555-123-4567", "(555) 123 4567", "078-05-1120", "ssn", "social", "x" * 45, "Fax:", "1", "é你", "tel.", "\n", "security,"]
        docs = spark.createDataFrame([(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 16)))) for i in range(300)], "doc_id long, text string")
    got = Counter((r["doc_id"], tuple(s for s in r["spans"].split(",") if s.split(":")[0] in ("iban", "local", "ssn"))) for r in pii.report(docs).collect())
    expected = Counter((r["doc_id"], tuple(added(r["text"] or ""))) for r in docs.collect())
    assert got == expected and (which == "table" or sum(n for (_, s), n in got.items() if s) > 0)


def test_redaction(spark):
    docs = edges(spark, clashing=True)
    got = pii.redact(docs)
    assert got.columns == docs.columns and got.count() == len(edge_rows())
    texts = [r["text"] for r in got.collect()]
    assert not any(t and "a.b@example.org" in t for t in texts)
    assert sum(t is None for t in texts) == sum(r[1] is None for r in edge_rows())


def test_empty_table(spark):
    none = edges(spark).filter("false")
    assert secrets.report(none).count() == pii.report(none).count() == pii.redact(none).count() == 0
