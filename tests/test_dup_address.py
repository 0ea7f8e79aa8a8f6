"""dup_address_flag against plain Python: a flag per row, similar company names taken out of the address."""

import re
from collections import Counter
from difflib import SequenceMatcher

from quartzite.plans import cleaning

KEY = lambda v: re.sub("[^A-Z0-9]", "", (v or "").upper())


def address_key(r):
    """Street, zip and city of the view's two kinds of address that have all three; None for the others."""
    parts = [p.strip() for p in (r.business_address or "").split("|")]
    if len(parts) < 5:
        return None
    front = parts[:-4]
    street = next((p for p in front if p[:1].isdigit() or not any(KEY(n) and SequenceMatcher(None, KEY(p), KEY(n)).ratio() > 0.85 for n in (r.lgl_nm, r.dba_nm))), front[-1])
    return KEY(street), parts[-2].zfill(5), KEY(parts[-4])


def test_flags(spark, sf_dir):
    rows = cleaning.contacts(spark, sf_dir).collect()
    keys = {r.rid: address_key(r) for r in rows}
    count = Counter(keys.values())
    want = {i: "Yes" if k and count[k] > 1 else "No" for i, k in keys.items()}
    got = cleaning.QUERIES["dup_address_flag"](spark, sf_dir).collect()
    assert len(got) == len(rows) and {r.rid: r.Duplicate_Address_CHECK for r in got} == want
    similar = [r.rid for r in rows if r.rid % 6 == 0 and r.rid % 5 in (1, 2, 3)]
    assert any(want[i] == "Yes" for i in similar)
