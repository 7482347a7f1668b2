"""Credentials of any length are found whole, and nothing of them stays in the text."""

import pytest

from palimpsest.llm import secrets

BODY = "\n".join("MIIEx7Qk9" * 7 for _ in range(400))
HEADERS = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-256-CBC,0123456789ABCDEF0123456789ABCDEF\n\n"
LONG = {
    "assigned": ('token="', "aB3xY9" * 50, '" end'),
    "assigned to a long name": ("a" * 20 + "_" + "b" * 20 + "_password=", "hunter2hunter2", " end"),
    "provider": ("key ", "sk-proj-" + "a1B2c3" * 25, " end"),
    "provider with hyphens": ("key ", "sk-proj-" + "a1B2c3-" * 40 + "z", " end"),
    "github": ("key ", "ghp_" + "a1B2c3" * 20, " end"),
    "jwt payload": ("auth ", "eyJ" + "a1" * 300 + ".eyJ" + "b2" * 1100 + "." + "c3" * 50, " end"),
    "jwt signature": ("auth ", "eyJhbGciOiJSUzI1NiJ9.eyJ" + "b2" * 20 + "." + "c3" * 600, " end"),
    "private key": ("x ", f"-----BEGIN RSA PRIVATE KEY-----\n{BODY}\n-----END RSA PRIVATE KEY-----", " end"),
    "encrypted private key": ("x ", f"-----BEGIN RSA PRIVATE KEY-----\n{HEADERS}{BODY}\n-----END RSA PRIVATE KEY-----", " end"),
    "private key cut off": ("x ", f"-----BEGIN PRIVATE KEY-----\n{BODY}", ""),
}


@pytest.mark.parametrize("case", LONG)
def test_long_credentials_are_found_whole(case):
    before, value, after = LONG[case]
    text = before + value + after
    assert [text[f[4] : f[5]] for f in secrets.findings(text) if f[1] == "secret"] == [value]


def test_nothing_of_a_long_credential_stays(spark):
    df = spark.createDataFrame([(k, "".join(x)) for k, x in enumerate(LONG.values())], "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert got == {k: f"{a}[secret]{b}" for k, (a, _, b) in enumerate(LONG.values())}
