"""Words and addresses beside letters outside ASCII."""

from postings_engine.functions import geo
from postings_engine.operators import enrich
from checks.projection import PROFILE


def test_an_address_ends_at_a_letter_it_cannot_hold(spark):
    df = spark.createDataFrame([("a", "mail jo.doe@mail.acme.comß now"), ("b", "éjo@acme.org"), ("c", "jo@acme.com_")], "posting_id string, description string")
    got = {r.posting_id: r.public_email for r in enrich.extract_contacts(df).collect()}
    assert got == {"a": "jo.doe@mail.acme.com", "b": "jo@acme.org", "c": ""}


def test_a_time_zone_beside_a_letter_outside_ascii(spark):
    df = spark.createDataFrame([("a", "istß"), ("b", "ist"), ("c", "list"), ("d", "ist_")], "posting_id string, r_hay string")
    got = {r.posting_id: len(r.standing_concerns) for r in geo.standing_concerns(df, PROFILE).collect()}
    assert got == {"a": 1, "b": 1, "c": 0, "d": 0}
