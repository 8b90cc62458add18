"""Claims, suffix automata, tool outputs and conversations against plain versions and examples."""

import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from siftwork.functions import claims, tool_output


@settings(max_examples=150, deadline=None)
@given(st.text("abc", max_size=30), st.text("abc", max_size=30))
def test_longest_common(a, b):
    runs = {a[i:j] for i in range(len(a)) for j in range(i + 1, len(a) + 1)}
    assert claims.longest_common(a, b) == max((len(r) for r in runs if r in b), default=0)


def test_what_can_be_looked_up():
    assert claims.content_words("The Engine returns twelve cached_values from disk") == {"engine", "returns", "twelve", "cached_values", "disk"}
    assert claims.numbers("It costs $1,200.50, 007 or 30% of three") == ["1200.50", "7", "30", "3"]
    assert claims.entities('She met "the cat" at NASA in New York, then NASA again') == ["the cat", "NASA", "She", "New York"]
    assert claims.sentences("One here. Two\nthree!  Four") == [(0, "One here."), (10, "Two"), (14, "three!"), (22, "Four")]
    assert claims.windows("a" * 2000) == ["a" * 900, "a" * 900, "a" * 200] and claims.windows("") == []
    assert claims.plain("Well,  it's 5% of X-ray!") == "well it's 5% of x-ray"
    assert [claims.claim_kind(x) for x in ("call foo()", "it has 5 parts", "the sky is blue")] == ["code_ref", "quantity", "proposition"]
    assert [claims.is_claim(x) for x in ("Is it so?", "what then", "The sky is blue", "json", "go on", "x")] == [False, False, True, False, False, False]


def test_certificates():
    context = "Alice founded Acme in 1999. The company has 120 workers in Paris. Revenue grew to 5 million."
    found = claims.analyse(context, "Alice founded Acme in 1999. Acme has 300 workers in Paris. Bob likes Berlin. Is that so?")
    assert [c.label for c in found] == ["grounded", "unknown", "unknown"]
    assert found[0].support == 0.82 and found[0].risk == round(0.35 * 0.18, 4)
    against = claims.analyse("Alice Acme Paris workers 120.", "Alice Acme Paris workers 300")[0]
    assert (against.label, against.contradiction) == ("unknown", 0.0)  # the number itself is looked up too
    assert claims.certify(0.9, 0.7, 1.0) == ("contradicted", 0.92) and claims.certify(0.1, 0.1, 0.8) == ("unsupported", 0.80)
    text = "Alice founded Acme in 1999. Bob likes Berlin."
    found = claims.analyse(context, text)
    assert claims.rewrite(text, found, "audit") == text
    assert claims.rewrite(text, found, "strict") == "Alice founded Acme in 1999."
    assert claims.rewrite(text, found, "annotate") == "Alice founded Acme in 1999. Bob likes Berlin. [unknown]"
    assert claims.rewrite(text, found, "strict", "chat") == text
    assert claims.analyse("", "Bob is here") != [] and claims.analyse("x", "") == []


def plain_under(lines, hit, first_rule=None):
    """Line by line: what is kept with the failures above it."""
    out, inside, indent = [], False, 0
    for x, h in zip(lines, hit, strict=True):
        depth = len(x) - len(x.lstrip())
        if h:
            inside, indent = True, depth
            out.append(x)
        elif inside:
            if not x.strip() or depth > indent:
                out.append(x)
            else:
                inside = False
                if first_rule and first_rule(x.strip()):
                    out.append(x)
        elif first_rule and x.strip().startswith(("ok ", "running ")):
            out.append(x)
    return out


def test_blocks_of_lines_are_those_of_a_line_by_line_pass():
    rng = random.Random(2)
    words = ["test a ... ok", "FAILED here", "  detail", "    more", "", "ok pkg", "running 3 tests", "plain", "error: bad", "warning: odd", "  | x", "test result: done", "test b", " note: z"]
    for _ in range(200):
        lines = ["running 5 tests"] + [rng.choice(words) for _ in range(rng.randrange(1, 40))]
        text = "\n".join(lines)
        hit = [bool(tool_output._TEST.search(x)) for x in lines]
        want = plain_under(lines, hit, lambda b: bool(b) and not b.startswith("test ") and "... ok" not in b)
        found = tool_output.test_output(text)
        assert (found or "").split("\n")[len(lines) > len(want) + 5 :] == (want or [""])
        hit = [bool(tool_output._BUILD.search(x)) for x in lines]
        found = tool_output.build_errors(text)
        if found is not None:
            want = plain_under(lines, hit)
            assert found.split("\n")[len(lines) > len(want) + 5 :] == want


def test_tool_outputs():
    diff = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,9 +1,9 @@\n c1\n c2\n c3\n-old\n+new\n d1\n d2\n d3\n d4\ndiff --git a/y b/y\nindex 1\n@@ -1 +1 @@\n e1"
    assert tool_output.git_diff(diff) == "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,9 +1,9 @@\n c1\n c2\n-old\n+new\n d1\n d2\ndiff --git a/y b/y\n@@ -1 +1 @@\n e1"
    log = "commit abcdef1234\nAuthor: x\nDate: y\n\n    First line\n    second\n\ncommit 99887766\nAuthor: z\n\n    Other\n"
    assert tool_output.git_log(log) == "abcdef1 First line\n9988776 Other"
    listing = "total 9\n" + "\n".join(f"{'drwxr-xr-x' if k % 2 else '-rw-r--r--'} 1 root root {k * 1000} Jan 1 10:00 name {k}" for k in range(6)) + "\n"
    assert tool_output.directory_listing(listing) == "Dirs (3):\n  name 1/\n  name 3/\n  name 5/\nFiles (3):\n  name 0 (0B)\n  name 2 (2.0K)\n  name 4 (3.9K)"
    status = "On branch main\nYour branch is ahead\n\nChanges not staged:\n  (use git add)\n\tmodified:   a.py\n\nUntracked files:\n\tb.py\n\nno changes added\n" + " " * 300
    assert tool_output.git_status(status) == "On branch main\nYour branch is ahead\nChanges not staged:\n  modified:   a.py\nUntracked files:\n  b.py"
    lines = "\n".join(f"2024-01-01 10:00:{k:02d} same message of some length" for k in range(40))
    assert tool_output.compress_tool_output(lines) == ("2024-01-01 10:00:00 same message of some length  [×40]", "log")
    blob = json.dumps([{"k": "v" * 60, "n": k} for k in range(40)])
    assert tool_output.compress_tool_output(blob)[1] == "json" and tool_output.compress_tool_output("short") == ("short", "none")
    assert json.loads(tool_output.shorten_json_argument(json.dumps({"a": "x" * 3000, "b": list(range(20))}))) == {"a": "<…3000 chars>", "b": [*range(8), "<…12 more>"]}
    assert tool_output.shorten_json_argument("{" * 3000) == "{" * 2000 + "…"


def test_conversations():
    talk = "# Head\n- point\n" + "long prose without any mark " * 5 + "\n```\n" + "\n".join(f"line {k}" for k in range(40)) + "\n```\nWe fix the bug because it fails\nshort"
    found = tool_output.skeleton(talk).split("\n")
    assert found[:3] == ["# Head", "- point", "```"] and "line 29" in found and "line 30" not in found and found[-2:] == ["We fix the bug because it fails", "short"]
    known = frozenset(["we fix the", "fix the bug", "the bug because", "bug because it", "because it fails"])
    assert "We fix the bug because it fails" not in tool_output.skeleton(talk, known).split("\n")
    text = " ".join(f"Sentence {k} has word{k} and more words." for k in range(30))
    assert tool_output.digest(text).count("\n") == 6 and tool_output.digest("One. Two.") == "One. Two."
    roles = ["user", "assistant"] * 8
    texts = [f"q{k} " + text if k % 2 else "short question" for k in range(16)]
    pruned = tool_output.prune_turns(roles, texts)
    assert pruned[12:] == texts[12:] and all(len(a) < len(b) for a, b in zip(pruned[1:6:2], texts[1:6:2], strict=True)) and pruned[0] == texts[0]
    assert tool_output.prune_turns(roles[:6], texts[:6]) == texts[:6]
    fitted = tool_output.fit_messages(roles, texts, 2000)
    assert fitted[-4:] == texts[-4:] and sum(map(len, fitted)) < sum(map(len, texts)) and tool_output.fit_messages(roles, texts, 10**6) == texts
    assert tool_output.fit_messages(["user", "tool", "user"], [text, text, text], 50, 2)[2] == text
