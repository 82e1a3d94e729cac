import random

from quartzite.llm import secrets


def kinds(text, reach=256):
    return [k for _, _, k in secrets.scan(text, reach)[1]]


def test_parts_longer_than_reach_are_linked():
    key = "aB3" * 100
    assert kinds(f"https://x.org/a client_id = abcd1234 {key}") == ["endpoint", "weak_id", "bare_key"]
    assert kinds(f"{key} {'w ' * 100}client_id = abcd1234") == ["bare_key", "weak_id"]
    assert kinds(f"client_id = abcd1234 {'f0' * 200}") == ["weak_id", "hex"]
    assert kinds(f"https://x.org/{'p' * 400} client_id = abcd1234 token={'z9' * 200}") == ["endpoint", "weak_id", "assign"]
    assert kinds(f"{key}\n\nclient_id = abcd1234") == kinds(f"client_id = abcd1234\n\n{key}") == []
    assert kinds(f"{key} {'w ' * 200}client_id = abcd1234") == []


def test_without_reach_the_scope_is_the_limit():
    key, far = "aB3" * 10, "w " * 5000
    assert kinds(f"{key} {far}client_id = abcd1234 {far}https://x.org/a", None) == ["bare_key", "weak_id", "endpoint"]
    assert kinds(f"{key} {far}\n \n client_id = abcd1234", None) == []
    assert kinds(f"{far}https://x.org/a {far} client_id = abcd1234", None) == []


def test_links_are_the_pairs_with_a_small_gap():
    rng = random.Random(5)
    for _ in range(300):
        made = [rng.choice(["client_id = " + "a1b2" * rng.randint(1, 9), "aB3" * rng.randint(7, 20), "w " * rng.randint(1, 20), "\n\n", "\n"]) for _ in range(rng.randint(2, 9))]
        text = " ".join(made)
        ids = [m.span() for m in secrets.WEAK_ID.finditer(text)]
        keys = [m.span() for m in secrets.BARE_KEY.finditer(text) if secrets._mixed(m[0])]
        near = lambda a, b: max(a[0], b[0]) - min(a[1], b[1]) <= 25 and not secrets.BLANK.search(text[min(a[1], b[1]) : max(a[0], b[0])])  # noqa: E731, B023
        base, every = secrets.scan(text, 25)
        if not base:
            want = [(*a, "weak_id") for a in ids if any(near(a, b) for b in keys)] + [(*b, "bare_key") for b in keys if any(near(a, b) for a in ids)]
            assert every == secrets.in_order(want)


def test_identifiers_in_any_case_are_linked():
    key = "aB3" * 10
    for name in ("client_id = ", "CLIENT_ID=", "clientId: ", "AccessKeyID=", "AWS_ACCESS_KEY_ID=", "USER_ID="):
        assert kinds(f"{name}abcd1234\n{key} https://x.org/a") == ["weak_id", "bare_key", "endpoint"]
    assert kinds(f"ASIA1234ABCD5678\n{key}") == ["weak_id", "bare_key"]
    assert kinds(f"asia1234ABCD5678\n{key}") == kinds(f"CLIENT=abcd1234\n{key}") == []
