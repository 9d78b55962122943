"""Change sets (S4, S5, W1, W4-W11): accepted + rejected = input, reasons in
the reference's order, tables rewritten by joins."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quadrangle.operators import changes, quality
from quadrangle.sources.schemas import SCHEMAS

AS_OF = dt.datetime(2024, 5, 1, 10, 0, 0)


def test_add_absences_reasons_and_defaults(spark):
    students = spark.createDataFrame([(1,), (2,)], "id long")
    courses = spark.createDataFrame([(10,), (11,)], "id long")
    enrol = spark.createDataFrame([(1, 10), (2, 10), (1, 11)], "etudiant_id long, cours_id long")
    base = spark.createDataFrame([(5, 1, 10, dt.date(2024, 1, 2), None, False)],
                                 "id long, etudiant_id long, cours_id long, date_absence date, "
                                 "motif string, justifiee boolean")
    batch = spark.createDataFrame([
        (1, "1", "10", "2024-01-03", None, "true"),     # clean
        (2, "x", "10", "2024-01-03", None, "true"),     # invalid id
        (3, "3", "10", "2024-01-03", None, "false"),    # no such student
        (4, "1", "12", "2024-01-03", None, "false"),    # no such course
        (5, "2", "11", "2024-01-03", None, "false"),    # not enrolled
        (6, "1", "10", "2024-01-02", None, "false"),    # duplicate of stored row
        (7, "1", "10", "2024-01-03", "m", "false"),     # duplicate of row 1 in batch
        (8, "1", "11", "2024-01-04", None, "maybe"),    # bad boolean
    ], "seq long, etudiant_id string, cours_id string, date_absence string, motif string, "
       "justifiee string")
    batch = batch.select("seq", F.col("etudiant_id"), F.col("cours_id"),
                         F.col("date_absence"), "motif", "justifiee")
    cs = changes.add_absences(base, batch, students, courses, enrol, as_of=AS_OF)
    reasons = {r.seq: r.reason for r in cs.rejected.collect()}
    assert reasons == {2: "invalide", 3: "etudiant_introuvable", 4: "cours_introuvable",
                       5: "non_inscrit", 6: "doublon", 7: "doublon_lot", 8: "invalide"}
    acc = cs.accepted.collect()
    assert [r.id for r in acc] == [5 + 1]            # max(id) + seq
    assert acc[0].justifiee is True and acc[0].created_at == AS_OF
    assert cs.table.count() == 2
    assert cs.table.columns == [f.name for f in SCHEMAS["absences"].fields]


def test_add_students_two_unique_keys(spark):
    base = spark.createDataFrame([(1, "ETU-1", "a@x.fr")],
                                 "id long, matricule string, email string")
    batch = spark.createDataFrame([
        (1, "ETU-2", "N", "P", "b@x.fr", "1", "L1", "1"),
        (2, "ETU-1", "N", "P", "c@x.fr", "1", "L1", "1"),   # matricule stored
        (3, "ETU-3", "N", "P", "b@x.fr", "1", "L1", "1"),   # email of row 1
        (4, "ETU-4", "N", "P", "not-an-email", "1", "L1", "9"),
    ], "seq long, matricule string, nom string, prenom string, email string, "
       "departement_id string, niveau string, annee_etude string")
    cs = changes.add_students(base, batch, as_of=AS_OF)
    assert {r.seq: r.reason for r in cs.rejected.collect()} == {
        2: "doublon", 3: "doublon_lot", 4: "invalide"}
    assert cs.table.count() == 2


def test_validation_keeps_every_failure_in_rule_order(spark):
    df = spark.createDataFrame([("", "x", None, "25", "0.05", "2024-13-01")],
                               "etudiant_id string, cours_id string, type_evaluation string, "
                               "note string, coefficient string, date_evaluation string")
    r = quality.validate(df, quality.RULES["grade"]).first()
    assert r.errors == ["etudiant_id", "cours_id", "type_evaluation", "note", "coefficient",
                        "date_evaluation"]
    ok = spark.createDataFrame([("1", "2", "CC", "20", "0.1", "2024/02/29")], df.schema)
    assert quality.validate(ok, quality.RULES["grade"]).first().errors == []


def test_timetable_rule_pattern_and_enums(spark):
    df = spark.createDataFrame([("1", "Lundi", "9:00", "23:59", "S1", "tp"),
                                ("1", "lundi", "24:00", "9:5", "", "amphi")],
                               "cours_id string, jour string, heure_debut string, "
                               "heure_fin string, salle string, type_seance string")
    e = [r.errors for r in quality.validate(df, quality.RULES["timetable"]).collect()]
    assert e == [[], ["jour", "heure_debut", "heure_fin", "salle", "type_seance"]]


def test_full_update_checks_existence_and_uniqueness(spark):
    base = spark.createDataFrame([(1, "C-1", "A"), (2, "C-2", "B")],
                                 "id long, code string, nom string")
    ch = spark.createDataFrame([(1, 1, "C-9", "A2"), (2, 2, "C-1", "B2"), (3, 7, "C-7", "Z")],
                               "seq long, id long, code string, nom string")
    cs = changes.full_update(base, ch, ["code", "nom"], "cours")
    assert {r.seq: r.reason for r in cs.rejected.collect()} == {2: "doublon", 3: "introuvable"}
    assert {r.id: (r.code, r.nom) for r in cs.table.collect()} == {1: ("C-9", "A2"),
                                                                   2: ("C-2", "B")}


def test_justification_sets_motif_only_when_given(spark):
    base = spark.createDataFrame([(1, False, "old"), (2, False, "old")],
                                 "id long, justifiee boolean, motif string")
    ch = spark.createDataFrame([(1, 1, "true", "new", True), (2, 2, "true", None, False)],
                               "seq long, id long, justifiee string, motif string, "
                               "motif_given boolean")
    cs = changes.justify_absences(base, ch)
    got = {r.id: (r.justifiee, r.motif) for r in cs.table.collect()}
    assert got == {1: (True, "new"), 2: (True, "old")}


def test_guarded_and_plain_delete(spark):
    depts = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "id long, nom string")
    students = spark.createDataFrame([(10, 1), (11, 1)], "id long, departement_id long")
    profs = spark.createDataFrame([(20, 2)], "id long, departement_id long")
    courses = spark.createDataFrame([(30, None)], "id long, departement_id long")
    keys = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    cs = changes.guarded_delete(depts, keys, {
        "etudiants": (students, "departement_id"), "professeurs": (profs, "departement_id"),
        "cours": (courses, "departement_id")})
    rej = {r.id: (r.reason, r.etudiants, r.professeurs) for r in cs.rejected.collect()}
    assert rej == {1: ("enfants", 2, 0), 2: ("enfants", 0, 1), 4: ("introuvable", None, None)}
    assert [r.id for r in cs.table.collect()] == [1, 2]
    d = changes.delete(students, spark.createDataFrame([(10,), (99,)], "id long"))
    assert [r.id for r in d.table.collect()] == [11]
    assert [r.id for r in d.rejected.collect()] == [99]


def test_post_payments_marks_bill_paid_whatever_the_amount(spark):
    bills = spark.createDataFrame([(1, 100.0, "pending"), (2, 50.0, "pending")],
                                  "id long, amount double, status string")
    pays = spark.createDataFrame([], "id long, paymentNumber string, billId long, amount double")
    batch = spark.createDataFrame([(1, 1, 7, 1.0, "cash", None)],
                                  "seq long, billId long, studentId long, amount double, "
                                  "method string, reference string")
    cs, new_bills = changes.post_payments(bills, pays, batch, AS_OF)
    p = cs.accepted.first()
    assert p.paymentNumber == "PAY-2024-000001" and p.status == "completed"
    assert p.date == dt.date(2024, 5, 1)
    assert {r.id: r.status for r in new_bills.collect()} == {1: "paid", 2: "pending"}


def test_issue_bills_and_staff(spark):
    bills = spark.createDataFrame([(3, "FAC-1", 1, 5.0)],
                                  "id long, invoiceNumber string, studentId long, amount double")
    batch = spark.createDataFrame([(1, 1, 9.5, "frais", dt.date(2024, 6, 1))],
                                  "seq long, studentId long, amount double, description string, "
                                  "dueDate date")
    cs = changes.issue("bill", bills, batch, AS_OF)
    r = cs.accepted.first()
    assert (r.id, r.invoiceNumber, r.status, r.issueDate) == (
        4, "FAC-2024-000001", "pending", dt.date(2024, 5, 1))
    staff = spark.createDataFrame([], "id long, employeeId string, email string")
    nb = spark.createDataFrame([(1, "A", "B", "a@x.fr")],
                               "seq long, firstName string, lastName string, email string")
    s = changes.issue("teaching_staff", staff, nb, AS_OF).accepted.first()
    assert s.employeeId == "ENS-2024-000001" and s.status == "active"


def test_enrol_and_scholarships(spark):
    enrol = spark.createDataFrame([(1, 1, 10)], "id long, etudiant_id long, cours_id long")
    students = spark.createDataFrame([(1,), (2,)], "id long")
    courses = spark.createDataFrame([(10,)], "id long")
    batch = spark.createDataFrame([(1, "1", 10), (2, "2", 10), (3, "2", 10), (4, "2", 11),
                                   (5, "3", 10)], "seq long, etudiant_id string, cours_id long")
    cs = changes.enrol(enrol, batch, students, courses, as_of=AS_OF)
    assert {r.seq: r.reason for r in cs.rejected.collect()} == {
        1: "deja_inscrit", 3: "deja_inscrit", 4: "cours_introuvable", 5: "etudiant_introuvable"}
    assert cs.accepted.first().statut == "active"
    reqs = spark.createDataFrame([], "id long, nom string")
    b = spark.createDataFrame([(1, "N", "P", "06", "a@b.c", "C", 0.0),
                               (2, "N", "P", None, "a@b.c", "C", 12.0)],
                              "seq long, nom string, prenoms string, telephone string, "
                              "email string, serieBac string, moyenneBac double")
    s = changes.submit_scholarships(reqs, b, as_of=AS_OF)
    assert [r.statut for r in s.accepted.collect()] == ["En attente"]
    assert [r.seq for r in s.rejected.collect()] == [2]
    st = changes.set_scholarship_status(
        s.table, spark.createDataFrame([(1, 1, "Acceptée"), (2, 9, "x")],
                                       "seq long, id long, statut string"))
    assert [r.statut for r in st.table.collect()] == ["Acceptée"]
    assert [r.reason for r in st.rejected.collect()] == ["introuvable"]


def test_typed_validation_equals_text_validation(spark):
    df = spark.createDataFrame([
        (1, 2, "A", 20.0, 0.1, dt.date(2024, 2, 29)),
        (None, 2, "", 20.5, 0.0, None),
        (3, None, "B", float("nan"), float("inf"), dt.date(1999, 1, 1)),
        (-4, 5, None, -0.0, 1e300, dt.date(2024, 1, 1)),
    ], "etudiant_id long, cours_id long, type_evaluation string, note double, "
       "coefficient double, date_evaluation date")
    as_text = df.select([F.col(c).cast("string").alias(c) for c in df.columns])
    a = [r.errors for r in quality.validate(df, quality.RULES["grade"]).collect()]
    b = [r.errors for r in quality.validate(as_text, quality.RULES["grade"]).collect()]
    assert a == b
    assert a[0] == [] and a[2] == ["cours_id", "note", "coefficient"]


def test_document_numbers_go_on_and_stay_whole(spark):
    bills = spark.createDataFrame([(9, "FAC-2024-000041", 1, 5.0), (3, "FAC-2023-000900", 1, 5.0), (4, "FAC-77", 1, 5.0)],
                                  "id long, invoiceNumber string, studentId long, amount double")
    batch = spark.createDataFrame([(1, 1, 9.5), (2, 1, None), (1234567, 1, 1.0), (123456, 1, 2.0), (1234560, 1, 3.0)],
                                  "seq long, studentId long, amount double")
    one = changes.issue("bill", bills, batch, AS_OF)
    assert sorted(r.invoiceNumber for r in one.accepted.collect()) == [
        "FAC-2024-000042", "FAC-2024-1234601", "FAC-2024-1234608", "FAC-2024-123497"]
    assert [(r.seq, r.reason) for r in one.rejected.collect()] == [(2, "valeur_manquante")]
    two = changes.issue("bill", one.table, batch.filter("seq = 1"), AS_OF)  # numbered from 1 again
    assert [r.invoiceNumber for r in two.accepted.collect()] == ["FAC-2024-1234609"]


def test_payment_numbers_are_unique_over_batches(spark):
    bills = spark.createDataFrame([(1, 100.0, "pending")], "id long, amount double, status string")
    pays = spark.createDataFrame([], "id long, paymentNumber string, billId long, amount double")
    batch = spark.createDataFrame([(1, 1, 1.0), (2, 1, 2.0)], "seq long, billId long, amount double")
    first, _ = changes.post_payments(bills, pays, batch, AS_OF)
    second, _ = changes.post_payments(bills, first.table, batch, AS_OF)
    numbers = [r.paymentNumber for r in second.table.collect()]
    assert len(numbers) == len(set(numbers)) == 4


def test_staff_keys_are_decided_together(spark):
    staff = spark.createDataFrame([(1, "ENS-2024-000001", "a@x.fr")], "id long, employeeId string, email string")
    batch = spark.createDataFrame([(1, "A", "B", "a@x.fr"), (2, "A", "B", "b@x.fr"), (3, "A", "B", "b@x.fr"), (4, None, "B", "c@x.fr")],
                                  "seq long, firstName string, lastName string, email string")
    got = {r.seq: r.reason for r in changes.issue("teaching_staff", staff, batch, AS_OF).report.collect()}
    assert got == {1: "doublon", 2: None, 3: "doublon_lot", 4: "valeur_manquante"}


def test_full_update_last_change_wins_and_a_rejected_one_blocks_nobody(spark):
    cols = "id long, matricule string, email string"
    base = spark.createDataFrame([(1, "A", "a@x"), (2, "B", "b@x"), (3, "C", "c@x")], cols)
    run = lambda rows: {r.id: (r.matricule, r.email) for r in changes.full_update(
        base, spark.createDataFrame(rows, "seq long, " + cols), ["matricule", "email"], "etudiants").table.collect()}
    assert run([(1, 1, "A", "a1@x"), (2, 1, "A", "a2@x")])[1] == ("A", "a2@x")  # keeps its own number twice
    # the first is refused for its e-mail and doesn't hold the number against the second
    got = run([(1, 1, "Z", "b@x"), (2, 3, "Z", "z@x")])
    assert got == {1: ("A", "a@x"), 2: ("B", "b@x"), 3: ("Z", "z@x")}
    # of two rows that ask for one number the first has it
    assert run([(1, 1, "Y", "y@x"), (2, 3, "Y", "w@x")]) == {1: ("Y", "y@x"), 2: ("B", "b@x"), 3: ("C", "c@x")}


def test_checked_appends_with_a_written_batch(spark):
    one = spark.createDataFrame([(1,)], "id long")
    enrol = spark.createDataFrame([(1, 1, 1)], "id long, etudiant_id long, cours_id long")
    batch = spark.createDataFrame([(1, "1", 1), (2, "1", 1)], "seq long, etudiant_id string, cours_id long")
    plain, written = ({r.seq: r.reason for r in changes.enrol_check(enrol, batch, one, one, materialize=m).collect()}
                      for m in (False, True))
    assert plain == written == {1: "deja_inscrit", 2: "deja_inscrit"}
    absent = spark.createDataFrame([], "id long, etudiant_id long, cours_id long, date_absence date, motif string, justifiee boolean")
    rows = spark.createDataFrame([(1, "1", "1", "2024-01-03", None, "true"), (2, "1", "1", "2024-01-03", None, "true")],
                                 "seq long, etudiant_id string, cours_id string, date_absence string, motif string, justifiee string")
    got = [{r.seq: r.reason for r in changes.add_absences(absent, rows, one, one, enrol, as_of=AS_OF, materialize=m).report.collect()}
           for m in (False, True)]
    assert got[0] == got[1] == {1: None, 2: "doublon_lot"}


@pytest.mark.parametrize("n", [12, 10_000])
def test_tables_written_for_a_chain(spark, n):
    """Row i shares its first key with the row before it and its second with
    the one after it: every second row is in.  The tables written grow with
    the logarithm of the chain."""
    from quadrangle.plans import components as comp
    from quadrangle.plans import materialize as m

    written = []
    rows = spark.range(n).selectExpr("id AS seq", "concat('k', id DIV 2) AS k", "concat('e', (id + 1) DIV 2) AS e")
    plain = quality.materialize
    quality.materialize = comp.materialize = lambda df, label="m": written.append(label) or m.materialize(df, label)
    try:
        got = {r.seq: r.reason for r in quality.check_unique_multi(rows, [["k"], ["e"]]).collect()}
    finally:
        quality.materialize = comp.materialize = plain
    assert got == {i: (None if i % 2 == 0 else "doublon_lot") for i in range(n)}
    assert written.count("unique-rounds") <= 2 * quality.FIRST_ROUNDS
    assert written.count("components") <= 6 + 3 * n.bit_length()


def test_components_against_union_find(spark):
    import random

    from quadrangle.plans.components import components

    r = random.Random(6)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(230)] + [(7, 7)] + [(1000, 1000 + i) for i in range(1, 300)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_scratch_tables_can_be_removed(spark):
    from quadrangle.plans.materialize import cleanup, materialize

    t = materialize(spark.range(3), "gone")
    assert t.count() == 3
    assert cleanup(spark) and not cleanup(spark)
