"""The prose of a commit: what people wrote, without headers, trailers, code and what tools write.

`blocks` walks the lines of one text once. Messages give paragraphs, quoted lines blocks of their own;
in diffs only comments count. Names of things (paths, calls, identifiers, numbers, addresses) are
taken out, as they belong to no language.

Defined cases: null, empty and blank texts have no blocks; CR, CRLF and other line ends count as line ends; a text
in none of the export forms is a message.
"""

from __future__ import annotations

import re

# How exports begin lines that aren't prose, and how tools begin messages.
_HEADER = re.compile(r"(?:commit [0-9a-f]{7,40}|[Mm]erge: |[Aa]uthor: |[Dd]ate: |From [0-9a-f]{7,40} |From: |[Hh]ash: |Commit(?:ter)?: |AuthorDate: |CommitDate: |index [0-9a-f]|old mode |new mode |similarity index |rename (?:from|to) |--- |\+\+\+ |@@)")
_TRAILER = re.compile(r"[A-Za-z][A-Za-z-]*-(?:by|to|with): .*|(?:Change-Id|Fixes|Closes|Refs|Cc|Bug|Issue|See-also|Link|Reverts): ?\S.*|\(cherry picked from commit .*")
_TOOL = re.compile(
    r"""(?ix) (?:\[[^\]]*\]\s*|:\w+:\s*|\W{1,3}\s)*
    (?: merge\s(?:branch|branches|pull\srequest|remote-tracking|tag|commit|changes|upstream|conflict)\b
      | revert\s["'“«] | reapply\s["'“] | this\sreverts\scommit
      | bump\s\S+\s(?:from|to)\s | bumps?\s\S+\sfrom | (?:update|upgrade|pin)\s(?:dependency|dependencies|module)\b
      | \w+\(deps(?:-dev)?\)!?: | deps: | (?:chore\()?release\)?\s?:?\s?v?\d+\.\d | release\sv?\d | v?\d+\.\d+(?:\.\d+)*\s*$
      | auto-?(?:generated|mated|sync|matic)\b | (?:nightly|automatic|scheduled)\s(?:sync|update|build) | sync(?:ed|s)?\s(?:with|from|to|upstream|fork) | \[bot\] | prepare\s(?:for\s)?(?:next\s)?(?:release|development) | squashed\scommit )"""
)
_BOT = re.compile(r"(?:Author|From|author): *\S*(?:-bot\b|\[bot\]|\[auto\])")
_SUBJECT_MARKS = re.compile(r"^(?:\s*(?:\[[^\]]{1,40}\]|:[a-z_0-9+-]+:|[a-z]{2,12}(?:\([^)\s]*\))?!?:(?=\s)))+\s*")
_COMMENT = re.compile(r"\s*(?://+|#+(?![!\w])|/\*+|\*+(?!/)|--+|;+|%+|<!--|\"\"\"|''')\s+(\S.*?)\s*(?:\*+/|-->)?$")
_CODE_TAIL = re.compile(r".*[;{}),\w]\s+(?://+|#+|/\*+)\s+(\S.*?)\s*(?:\*/)?$")
_BULLET = re.compile(r"\s*(?:[-*+•]|\d{1,2}[.)])\s+")
_NAME = re.compile(
    r"""(?x) `[^`]*` | <[^<>\s]+@[^<>\s]+> | \S+@\S+\.\w+ | https?://\S+ | \b[0-9a-f]{7,40}\b
    | (?<![A-Za-z0-9_]) (?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]* | (?<![A-Za-z0-9_])[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+(?:\(\))? | (?<![A-Za-z0-9_])[A-Za-z_][A-Za-z0-9_]*\(\)
    | (?<![A-Za-z0-9_])[A-Za-z0-9]*_[A-Za-z0-9_]* | (?<![A-Za-z0-9_])[a-z]+[a-z0-9]*[A-Z][A-Za-z0-9]* | (?<![A-Za-z0-9_])[A-Z][a-z0-9]+[A-Z][A-Za-z0-9]* | [#@]\w+ | \d+"""
)
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])")
_LINES = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
MESSAGE, QUOTE, COMMENT = "message", "quote", "comment"


def blocks(text: str | None) -> list[tuple[str, str]]:
    """`(kind, prose)` of each block, in order; names are still in it."""
    if not text or text.isspace():
        return []
    out: list[tuple[str, str]] = []
    run: list[str] = []
    kind = MESSAGE
    diff = binary = False
    first = True
    tool = False
    head = True  # a mail's headers can go on after its subject

    def close() -> None:
        if run:
            out.append((kind, " ".join(run)))
            run.clear()

    def add(what: str, line: str, fresh: bool = False) -> None:
        nonlocal kind
        if what != kind or fresh:
            close()
            kind = what
        run.append(line)

    for line in _LINES.split(text):
        if line.startswith("diff --"):
            close()
            diff, binary = True, False
            continue
        if diff:
            if line.startswith("GIT binary patch"):
                binary = True
            if binary or line[:1] not in "+- " or line.startswith(("--- ", "+++ ", "-- ")):
                close()
                continue
            # A line can start with two marks, where a merge has two parents.
            code = line[1:]
            if code[:1] in "+-" and not code.startswith("--"):
                code = code[1:]
            m = _COMMENT.match(code) if ("/" in code or "#" in code or "*" in code or "-" in code or ";" in code or "%" in code or '"' in code or "'" in code) else None
            if m is None and (" // " in code or " # " in code or " /* " in code):
                m = _CODE_TAIL.match(code)
            if m:
                add(COMMENT, m.group(1))
            else:
                close()
            continue
        bare = line.strip()
        if not bare or bare == "---" or bare == "--":
            close()
            head = head and first
            continue
        tool = tool or (head and bool(_BOT.match(bare)))
        if line.startswith("Subject:"):
            close()
            bare = line[8:].strip()
        elif _HEADER.match(line):
            close()
            continue
        elif _TRAILER.fullmatch(bare) or re.fullmatch(r"\d+ files? changed.*|\d+\.\d+[\d.]*|# Conflicts:|#\s+\S+|\S+ \| +(?:\d+|Bin).*", bare):
            close()
            continue
        if first:
            first = False
            head = line.startswith("Subject:")
            tool = tool or bool(_TOOL.match(bare))
            bare = _SUBJECT_MARKS.sub("", bare)
            add(MESSAGE, bare, True)
            # A subject that goes on in the next line belongs together with it; an empty line ends it.
            continue
        if tool:
            continue
        if bare.startswith(">"):
            add(QUOTE, bare.lstrip("> "))
        elif m := _BULLET.match(line):
            add(MESSAGE, line[m.end() :].strip(), True)
        else:
            add(MESSAGE, bare)
    close()
    if tool:
        out = [b for b in out if b[0] == COMMENT]
    return out


def without_names(prose: str) -> str:
    return _NAME.sub(" ", prose)


def letters(prose: str) -> int:
    return sum(map(str.isalpha, prose))


def sentences(text: str | None) -> list[tuple[int, str, str]]:
    """`(block number, kind, sentence)` of a text, without names; sentences without letters are left out."""
    out = []
    for number, (kind, prose) in enumerate(blocks(text)):
        for s in _SENTENCE.split(prose):
            s = " ".join(without_names(s).split())
            if s and any(map(str.isalpha, s)):
                out.append((number, kind, s))
    return out
