from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.functions import speech
from tidemark.operators import messages

ROW = "id int, rule string, language string, observed map<string,double>, context map<string,string>"


def render(spark, rows, forms=messages.FORMS):
    made = messages.rendered(messages.with_slots(spark.createDataFrame(rows, ROW)), messages.templates(spark, forms))
    return {r.id: r for r in messages.for_speech(made).collect()}


def test_every_language_of_a_template_has_the_same_slots():
    for forms in messages.FORMS.values():
        assert set(forms) == {"en", "ta", "hi"} and len({tuple(sorted(messages.slots_of(f))) for f in forms.values()}) == 1
    assert set(messages.TEMPLATE_OF.values()) == set(messages.FORMS)


def test_slots_come_from_what_the_rule_has_seen(spark):
    told = {"location": "Mandapam", "valid_until": "18:00", "harbour": "Pamban", "distance": "12.5 km", "issued": "06:00", "system": "Alpha"}
    rows = [
        (1, "wave_height", "en", {"wave_height_m": 2.46}, told | {"wave_height": "9 m"}),
        (2, "wave_height", "hi", {}, told | {"wave_height": "9 m"}),
        (3, "geofence_drift", "ta", {"distance_km": 1.0, "minutes": 8.2}, {}),
        (4, "geofence_proximity", "en", {"distance_km": 1.0}, {}),
        (5, "squall", "en", {}, told),
        (6, "cyclone_wind", "bn", {}, told | {"authority": "IMD"}),
        (7, "wave_height", "en", {"wave_height_m": 2.46}, {"location": "x"}),
        (8, "no such rule", "en", {}, told),
        (9, "wind_speed", "en", None, None),
    ]
    got = render(spark, rows)
    assert got[1].text == "High waves of 2.5 m near Mandapam until 18:00. Source INCOIS." and got[1].spoken == "High waves of 2.5 metres near Mandapam until 18:00. Source INCOIS."
    assert "9 m" in got[2].text and "9 मीटर" in got[2].spoken and got[2].said_in == "hi"
    assert "1.0 கிலோமீட்டர்" in got[3].spoken and "8 நிமிடம்" in got[3].spoken and not got[3].drifted
    assert "an unknown time" in got[4].text and got[4].spoken.startswith("You are 1.0 kilometre from")
    assert "waves are not reported and wind is not reported" in got[5].text
    assert got[6].said_in == "en" and "Source IMD" in got[6].text and "moving unknown at unknown" in got[6].text
    assert got[7].text is None and got[7].missing == ["valid_until"] and got[7].note == "no value for valid_until"
    assert got[8].text is None and got[8].note == "no such template"
    assert got[9].text is None and got[9].missing == ["distance", "harbour", "location"]


def test_a_text_that_changes_a_number_is_withheld(spark):
    forms = {"high_wave": {"en": "Waves 1{wave_height} near {location} until {valid_until} by {authority}."}}
    got = render(spark, [(1, "wave_height", "en", {"wave_height_m": 2.0}, {"location": "x", "valid_until": "18:00"})], forms)
    assert got[1].text is None and got[1].note == "the text's numbers are not its slots'" and got[1].spoken is None


def test_headline(spark):
    texts = ["One. Two.", " . x", "a" * 200 + ". b", None, "no stop"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(messages.headline(F.col("t"))).collect()]
    assert got == ["One", ". x", "a" * 157 + "…", None, "no stop"]


@pytest.mark.parametrize(("text", "language", "want"), [("அலை 2.5 m.", "ta", "அலை 2.5 மீட்டர்."), ("12kn-15kn", "en", "12 knots-15 knots"), ("m m/s x%", "en", "metres metres per second x%"), ("2024-01-05", "en", "2024 to 01 to 05"), ("45 ° 30 °C", "en", "45 degrees 30 degrees Celsius")])
def test_spoken_tokens(spark, text, language, want):
    assert spark.createDataFrame([(text,)], "t string").select(speech.spoken(F.col("t"), language).alias("s")).first().s.text == want


def test_texts_are_read_out_as_their_tokens_say(spark):
    """The fast way over texts against the tokens' rendering, with every kind of neighbour."""
    import random

    from tidemark.functions import speech

    rng = random.Random(7)
    bits = [*speech.UNITS["en"], *speech.SIGNS, *speech.DASHES, *speech.CLOSING, "1", "1.0", "01", "12", "3.5", ".", " ", " ", "  ", "\t\n", "x", "लहर", "மீ", "C", "(", "-1", "1.1.1", " "]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))), rng.choice(["en", "hi", "ta"])) for i in range(3000)]
    given = spark.createDataFrame([*rows, (3000, None, "en"), (3001, "5 m", "bn")], "id int, text string, said_in string")
    want = {}
    for language in speech.UNITS:
        for r in given.where(F.col("said_in") == language).select("id", "text", speech.spoken(F.col("text"), language).alias("s")).collect():
            want[r.id] = (None, False) if r.text is None else (r.s.text, r.s.drifted)
    got = {r.id: (r.spoken, r.drifted) for r in messages.for_speech(given).collect()}
    assert got.pop(3001) == (None, False) and got == want


def test_a_small_file_of_vessels_makes_many_tasks(spark):
    from tidemark.plans import messages as plans

    assert plans.fired(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 8
