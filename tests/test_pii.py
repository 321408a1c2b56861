"""Validators, recognisers and redaction."""

from conftest import one
from pyspark.sql import functions as F

from docprep.functions import pii as P
from docprep.operators import pii as OP

BASE = "2801234567"
NSS = BASE + f"{int(BASE) % 97:02d}"
ALL = ["dni_nie", "email", "person", "phone", "iban", "credit_card", "ip", "social_security", "company_id", "vehicle_plate", "date"]


def test_dni_nie(spark):
    assert one(spark, P.valid_dni_nie, "12345678Z", "12345678A", "X1234567L", "1234567Z", "ABCDEFGHZ", " x1234567l ") == [
        True, False, True, False, False, True,
    ]


def test_nss(spark):
    other = NSS[:-2] + ("99" if NSS[-2:] != "99" else "00")
    assert one(spark, P.valid_nss, NSS, other, "123", "28/01234567/" + NSS[-2:]) == [True, False, False, True]


def test_cif(spark):
    assert one(spark, P.valid_cif, "A58818501", "A58818502", "12345678Z") == [True, False, False]


def test_iban_and_luhn(spark):
    assert one(spark, P.valid_iban_es, "ES27  0049  6794  01  2116034467", "ES0000000000000000000000", "es27 0049 6794 0121 1603 4467") == [True, False, True]
    assert one(spark, P.valid_luhn, "4539 5787 6362 1486", "4539578763621487", "", None) == [True, False, False, False]


def red(spark, text, keys):
    return one(spark, lambda c: P.redact(c, keys), text)[0]


def test_redaction_cases(spark):
    t = "Mi correo es ana@example.com y mi DNI 12345678Z."
    assert red(spark, t, ["email", "dni_nie"]) == "Mi correo es [EMAIL] y mi DNI [DNI]."
    assert red(spark, t, ["email"]) == "Mi correo es [EMAIL] y mi DNI 12345678Z."
    assert red(spark, t, []) == t
    assert red(spark, t, ["nope"]) == t
    assert red(spark, "El pedido 12345678A está listo.", ["dni_nie"]) == "El pedido 12345678A está listo."
    assert "[IBAN]" in red(spark, "Número de cuenta:ES27  0049  6794  01  2116034467", ["iban"])
    assert "[IBAN]" not in red(spark, "Ref ES0000000000000000000000 fin", ["iban"])
    assert red(spark, "Nombre: RUEDA TREVIÑO, ANTONIO\nOtro campo", ["person"]) == "Nombre: [NOMBRE]\nOtro campo"
    assert red(spark, "Vehículo 1234 BCD aparcado", ["vehicle_plate"]) == "Vehículo [MATRICULA] aparcado"
    assert red(spark, "Fecha de alta: 12/01/2024.", ["date"]) == "Fecha de alta: [FECHA]."
    assert red(spark, f"Nº afiliación: {NSS}", ["social_security"]) == "Nº afiliación: [NSS]"
    assert red(spark, "Empresa con CIF A58818501 en nómina", ["company_id"]) == "Empresa con CIF [CIF] en nómina"


def test_ip_v4_and_v6(spark):
    t = "hosts 10.0.0.1, 2001:db8::1 y fe80::1ff:fe23:4567:890a%eth0; std::vector a las 12:30:45"
    assert red(spark, t, ["ip"]) == "hosts [IP], [IP] y [IP]%eth0; std::vector a las 12:30:45"
    full = "gw 2001:0db8:85a3:0000:0000:8a2e:0370:7334."
    assert red(spark, full, ["ip"]) == "gw [IP]."
    df = spark.createDataFrame([(1, t)], "doc_id long, text string")
    spans = OP.detect_pii(df, "text", ["ip"]).collect()
    assert sorted(s.matched for s in spans) == ["10.0.0.1", "2001:db8::1", "fe80::1ff:fe23:4567:890a"]
    assert all(t[s.start:s.end] == s.matched for s in spans)


def test_label_quirks(spark):
    # a name in a table cell followed by '|' is not found; an empty value swallows the next line
    assert red(spark, "| Nombre: Ana | x |", ["person"]) == "| Nombre: Ana | x |"
    assert red(spark, "Nombre:\nJuan", ["person"]) == "Nombre:\n[NOMBRE]"


def test_spans_offsets_and_overlaps(spark):
    text = "ip 188.54.39.104 y tel +1 (743) 555-3824, DNI 12345678Z"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = OP.detect_pii(df, "text", ALL).collect()
    for s in spans:
        assert text[s.start:s.end] == s.matched
    kinds = {s.entity for s in spans}
    assert {"IP_ADDRESS", "PHONE_NUMBER", "ES_DNI_NIE"} <= kinds
    resolved = OP.detect_pii(df, "text", ALL, resolve=True).collect()
    ordered = sorted((s.start, s.end) for s in resolved)
    assert all(a[1] <= b[0] for a, b in zip(ordered, ordered[1:]))
    # the date rule matches inside the IP address; resolution keeps the IP only
    assert not any(s.entity == "DATE_TIME" for s in resolved)


def test_redact_resolved_equals_sequential_without_partial_overlaps(spark):
    text = "Mi correo es ana@example.com y mi DNI 12345678Z, ip 10.0.0.1"
    a = one(spark, lambda c: OP.redact_resolved(c, ALL), text)[0]
    b = one(spark, lambda c: P.redact(c, ALL), text)[0]
    assert a == b


def test_redact_spans_cuts_by_code_points(spark):
    text = "😀😀 ana@example.com ñ 10.0.0.1 😀 fin 2001:db8::1"
    df = spark.createDataFrame([(text,)], "t string")
    sp = P.resolve_overlaps(P.detect_spans(F.col("t"), ["email", "ip"]))
    want = "😀😀 [EMAIL] ñ [IP] 😀 fin [IP]"
    for chunk in (1, 2, 5, 1024):
        assert df.select(P.redact_spans(F.col("t"), sp, chunk=chunk)).first()[0] == want
    # overlap resolution gives the same spans whatever the block size
    a = df.select(P.resolve_overlaps(P.detect_spans(F.col("t"), ALL), block=2)).first()[0]
    b = df.select(P.resolve_overlaps(P.detect_spans(F.col("t"), ALL))).first()[0]
    assert a == b


def test_entity_parameters(spark):
    parsed = one(spark, OP.parse_entities, "email,person, dni_nie", None, " , ,")
    assert parsed == [["email", "person", "dni_nie"], [], []]
    known = one(spark, lambda c: OP.known_entities(OP.parse_entities(c)), "iban,bad,email,iban")
    assert known == [["iban", "email"]]
    tags = one(spark, lambda c: OP.entity_tags(OP.known_entities(OP.parse_entities(c))), "email,dni_nie")
    assert tags == [["[EMAIL]", "[DNI]"]]


def test_no_python_udf_in_redaction_plan(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = df.select(P.redact(F.col("text"), ALL).alias("r"))._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "Exchange" not in plan


def test_resolution_leaves_no_matched_text_uncovered(spark):
    # two date patterns overlap: the stretch becomes one date
    assert one(spark, lambda c: OP.redact_resolved(c, ["date"]), "el 1/2/2024/3/4 fin")[0].count("[FECHA]") == 1
    span = "struct<entity:string,start:int,end:int,score:double,matched:string>"
    rows = [[("A", 0, 5, 0.5, "abcde"), ("A", 3, 8, 0.9, "defgh"), ("B", 6, 10, 0.4, "ghij"), ("B", 7, 9, 0.4, "hi"), ("A", 9, 12, 0.1, "jkl")]]
    df = spark.createDataFrame([(r,) for r in rows], f"s array<{span}>")
    for block in (1, 2, 128):
        got = [tuple(x) for x in df.select(P.resolve_overlaps(F.col("s"), block=block)).first()[0]]
        assert got == [("A", 0, 8, 0.9, "abcdefgh"), ("B", 8, 10, 0.4, "ij"), ("A", 10, 12, 0.1, "kl")]
