import re

import pytest

from faultline.plans.dataprep import USUAL_FORMS


@pytest.mark.parametrize("zone", ["PST", "EDT", "EST", "CET", "CEST", "IST", "UTC", "AEDT", "AEST", "Z"])
def test_other_zones_are_not_the_usual_form(zone):
    assert not re.search(USUAL_FORMS["deploy_start_time"], f"2026-05-14T21:07:16.000 {zone}")


@pytest.mark.parametrize(("field", "value"), [("deploy_start_time", "2026-05-14T21:07:16.000 PDT"), ("search_time", "1751087057.109665000"), ("predicted_at", "2026-06-22T04:31:57.088513+00:00")])
def test_usual_form(field, value):
    assert re.search(USUAL_FORMS[field], value)
    assert not re.search(USUAL_FORMS[field], value + " ")
