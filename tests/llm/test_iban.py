"""IBANs beside other upper-case words, numbers and IBANs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.llm import pii

ES, AT, DE, PL = "ES91 2100 0418 4502 0005 1332", "AT611904300234573201", "DE89 3704 0044 0532 0130 00", "PL61 1090 1014 0000 0712 1981 2874"
CASES = [
    (f"{ES} BIC CAIXESBBXXX", [ES]), ("ES9121000418450200051332 2024", ["ES9121000418450200051332"]), (f"{AT} BIC X", [AT]), (f"to {PL} ABC", [PL]),
    (f"{ES} {AT} {DE} {PL}", [ES, AT, DE, PL]), (f"NO12 {ES} 1234", [ES]), (f"ES11 {ES}", [ES]), ("ES91 2100 0418 4502 0005 1333", []), (f"{AT}5", []),
    # a country without a listed length
    ("ZZ59 1234 5678 9012 3456 ABC", ["ZZ59 1234 5678 9012 3456"]), (f"é😀 {ES} 2024", [ES]),
]


def test_cases(spark):  # noqa: ANN001, ANN201
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    for r in pii.detect(df).collect():
        text, want = CASES[r["doc_id"]]
        assert [text[s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "iban"] == want, text
    for r in pii.redact(df).where(F.col("doc_id") < 3).collect():
        assert r["text"].startswith("[IBAN] ")


@pytest.mark.parametrize("n", sorted(pii.IBAN_LENGTHS))
def test_every_length(spark, n):  # noqa: ANN001, ANN201
    made = []
    for c in pii.IBAN_LENGTHS[n].split():
        body = ("123456789" * 4)[: n - 4]
        check = 98 - int("".join(str(int(x, 36)) for x in f"{body}{c}00")) % 97
        flat = f"{c}{check:02d}{body}"
        made += [flat, " ".join(flat[i : i + 4] for i in range(0, n, 4))]
    df = spark.createDataFrame([(i, f"{t} BIC 2024") for i, t in enumerate(made)], "doc_id long, text string")
    got = {r["doc_id"]: [s["end"] for s in r["spans"] if s["kind"] == "iban"] for r in pii.detect(df).collect()}
    assert got == {i: [len(t)] for i, t in enumerate(made)}
