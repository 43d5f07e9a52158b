"""Brute-force versions that several tests share."""

from test_decontam import brute as _contaminated
from test_secrets import brute as _secrets
from test_simhash import components, fingerprint


def simhash_brute(rows):
    group = components([fingerprint(t) for _, t in rows])
    least = {}
    for (d, _), g in zip(rows, group, strict=True):
        least[g] = min(least.get(g, d), d)
    return set(least.values())


def decontam_brute(rows, items):
    return {int(x.strip("(").split(",")[0]) for x in _contaminated(rows, items)}


def secrets_brute(text):
    return _secrets(text)[4]
