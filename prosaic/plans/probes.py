"""Literal rows for what readers, reviewers, judges and editors would have said: sentences of our own that reach every rule."""

from __future__ import annotations

PANEL = [
    ("editor", "momentum_loss", "It drags in Ch 5 and again in chapter 5; Chapter 12 is slow too."),
    ("editor", "cut_candidate", "Chapter 7 could go. So could Ch 12."),
    ("editor", "worst_scene", "The market in Chapter 5. Fix: begin with the quarrel. "),
    ("editor", "thinnest_character", "The aunt in Ch 9."),
    ("editor", "best_scene", "The bridge in Chapter 7 holds."),
    ("editor", "missing_scene", "A farewell after Chapter 9."),
    ("editor", "earned_ending", "Yes, Ch 24 mirrors Ch 1."),
    ("reader", "momentum_loss", "Ch 5, I think. Which 5 pages? The ones with rain."),
    ("reader", "cut_candidate", "Ch. 7 or Chapter 7, or Ch 7."),
    ("reader", "worst_scene", "None. Chapter 21 is fine."),
    ("reader", "best_scene", "The end of CHAPTER 12."),
    ("reader", "missing_scene", None),
    ("writer", "momentum_loss", "Never."),
    ("writer", "cut_candidate", "Chapter 7. The middle of it says everything twice."),
    ("writer", "worst_scene", "Ch 5: the fix is simple: cut the second speech"),
    ("writer", "thinnest_character", "Ch 0 has nobody; the uncle of chapter 9."),
    ("first", "momentum_loss", "Chapter 5 and Chapter 13."),
    ("first", "cut_candidate", "Chapter 7 for sure, and Chapter 2."),
    ("first", "worst_scene", ""),
]

REVIEWS = [
    (1, "A fine book.\n★★★★½ from me.\n\nProfessor Hart's Review\n1. Tempo\nThis is a significant flaw. Cut the second act.\nSuggestion: halve the letters.\n2. Echoes\nA minor, recurring gesture; each instance works.\n\nNothing else."),
    (2, "★★★★ good.\nThe professor gives an Assessment:\n\n1. Ending\nIt is individually fine, a deliberate choice.\n2. Voice\nA small complaint about frequency.\n3. Setting\nRestructure the middle; not a flaw as such.\n4. Names\nGive them more room.\n5. Order\nMove the fair. Thematically coherent."),
    (3, "I would say 4 out of 5.\n\nPROFESSOR Analysis\n1. Start\nPlain.\n2. Close\nPlain too."),
    (4, "No rating here and no second voice at all."),
    (5, "★★★ middling.\nProfessor's Craft notes\n1. One\nPrimary trouble: tics.\nSpecific suggestions:\nlist them, then trim.\n\nThen rest.\n2. Two\nSlight.\n3. Three\nAdd a scene."),
    (6, None),
]

REPLIES = [
    (1, '```json\n{"a": "}", "n": 1}\n``` and that is all'),
    (2, 'Sure: {"a": {"b": [1, 2]}} hope it helps {"c": 3}'),
    (3, '[1, 2, {"k": "v"}]'),
    (4, '{"a": "open'),
    (5, "no json here"),
    (6, '{"line": "one\ntwo"}'),
    (7, 'quote \\" then {"x": "a \\" b {"}'),
    (8, ""),
    (9, None),
    (10, '{"a": 1,}'),
    (11, '{"plain": true}'),
]

SCRIPTS = [
    (1, '[{"speaker": "NARRATOR", "text": "It rained."}, {"speaker": "ANNA", "text": "Come in."}]'),
    (2, '```json\n[{"speaker": "ANNA", "text": "Trailing"},\n{"speaker": "BEN", "text": "comma"},\n]\n```'),
    (3, 'Here: {"speaker": "BEN", "text": "Loose \\"one\\""} and {"speaker": "ANNA", "text": "two\\nlines"} end'),
    (4, "nothing of use"),
    (5, '[\n  {"speaker": "ANNA", "text": "One {brace}, two,]"},\n  {"text": "no order", "speaker": "BEN"},\n  {"speaker": "BEN", "te'),
]

#: What is read from REPLIES: id, and the JSON as a judge's, an editor's, a comparer's and a strict reply.
READ_REPLIES = [
    (1, *['{"a": "}", "n": 1}'] * 4),
    (2, *['{"a": {"b": [1, 2]}}'] * 4),
    (3, '{"k": "v"}', '[1, 2, {"k": "v"}]', '[1, 2, {"k": "v"}]', '{"k": "v"}'),
    (4, *[None] * 4),
    (5, *[None] * 4),
    (6, *['{"line": "one\\ntwo"}'] * 4),
    (7, *['{"x": "a \\" b {"}'] * 4),
    (8, *[None] * 4),
    (9, *[None] * 4),
    (10, *[None] * 4),
    (11, *['{"plain": true}'] * 4),
]

#: What is read from SCRIPTS: id, place (-1: nothing), speaker, text.
READ_SCRIPTS = [
    (1, 0, "NARRATOR", "It rained."), (1, 1, "ANNA", "Come in."), (2, 0, "ANNA", "Trailing"), (2, 1, "BEN", "comma"),
    (3, 0, "BEN", 'Loose "one"'), (3, 1, "ANNA", "two\nlines"), (4, -1, None, None), (5, 0, "ANNA", "One {brace}, two,]"),
]

OUTPUTS = [
    (1, "phase: chapter\noverall_score: 7.5\nraw_judge_score: 8\n"),
    (2, "overall_score: N/A\n  overall_score: 7 \nnote: x"),
    (3, "nothing\n"),
    (4, "overall_score:6.25\nlore_score: 5.5"),
    (5, "xoverall_score: 9\noverall_score: 3"),
    (6, None),
]

OUTLINES = [
    (1, "# Plan\n## Act I\n### Ch 1: Dawn\nA boy wakes.\nHe walks.\n### Ch 2: Noon\nHe meets Ada.\n## Act II\n### Chapter 3: Dusk\nRain.\n## Foreshadowing\n- the bell"),
    (2, "### Ch 10: Ten\nten\n### Ch 11: Eleven\neleven\nPart 1\nsee Part 2 here\nmore of it"),
    (3, "Nothing planned."),
]

#: chapter number, plants, harvests
THREADS = [
    (1, ["the cracked bell in the tower", "a letter without a stamp"], []),
    (2, ["the cracked bell in the tower"], ["a letter without a stamp"]),
    (3, ["a name that nobody in the whole town will say aloud, not even the priest, until the last of days"], ["the cracked bell in the tower"]),
    (4, [], ["a name that nobody in the whole town will say aloud, not even the priest, till noon", "a promise"]),
]

VOICES = [(0, "_comment", "x"), (1, "NARRATOR", "v-nar"), (2, "assistant", "v-ass"), (3, "user", "REPLACE_WITH_VOICE_ID"), (4, "MINOR", "v-min"), (5, "SYS", "")]

#: run, iteration, score, lore score
FOUNDATION = [("a", 1, 5.0, 6.0), ("a", 2, 4.5, 7.0), ("a", 3, 7.0, 6.5), ("a", 4, 7.6, 6.9), ("a", 5, 9.0, 8.0), ("b", 1, -1.0, -1.0), ("b", 2, 3.0, 3.0), ("b", 3, 3.0, 9.0), ("c", 1, 7.5, 8.0)]

#: chapter, attempt, drafted without error, bytes, score, words
ATTEMPTS = [
    (1, 1, True, 9000, 5.9, 1500), (1, 2, True, 9100, 6.0, 1520), (1, 3, True, 9100, 9.0, 1530),
    (2, 1, False, 0, None, 0), (2, 2, True, 50, 9.0, 8), (2, 3, True, 8000, 5.0, 1300), (2, 4, True, 8200, 5.5, 1310), (2, 5, True, 8300, 4.0, 1350), (2, 6, True, 8300, 9.0, 1350),
    (3, 1, False, 0, None, 0),
]

#: run, cycle, score
CYCLES = [("a", 1, 7.0), ("a", 2, 7.25), ("a", 3, 7.75), ("a", 4, 7.5), ("a", 5, 9.0), ("b", 1, 7.0), ("b", 2, 7.0), ("b", 3, 7.25), ("b", 4, 8.0), ("c", 1, 5.0)]

#: chapter, before, after
REVISIONS = [(1, 6.0, 6.5), (2, 7.0, 7.0), (3, 7.0, 6.5), (4, 6.0, None)]

#: run, round, stars, total, major, qualified
ROUNDS = [("a", 1, 3.5, 6, 2, 1), ("a", 2, 4.5, 5, 0, 1), ("a", 3, 5.0, 1, 0, 0), ("b", 1, 4.0, 5, 1, 3), ("b", 2, 2.0, 2, 1, 0), ("c", 1, None, 2, 0, 0), ("c", 2, 4.0, 4, 1, 2), ("c", 3, 3.0, 0, 0, 0), ("c", 4, 3.0, 3, 1, 0), ("c", 5, 5.0, 1, 0, 0)]

STATES = [(1, "foundation", None), (2, "revision", None), (3, "complete", None), (4, "unheard of", None), (5, None, None), (6, "export", "drafting")]

#: chapter, chunk, attempt, ok
CALLS = [(1, 0, 1, True), (1, 1, 1, False), (1, 1, 2, True), (1, 2, 1, False), (1, 2, 2, False), (1, 2, 3, False), (1, 2, 4, True), (2, 0, 1, True)]

LOGS = [
    ("20250101_100000_full.json", 6.5), ("20250103_090000_full.json", 7.25), ("20250102_235959_full.json", 7.0), ("20250101_110000_ch03.json", 5.0), ("20250104_110000_ch3.json", 6.0),
    ("20250102_110000_ch12.json", 8.0), ("20250101_120000_foundation.json", 7.5),
]

MARKDOWN = [
    (1, "# Chapter 3: The Bell\n\nIt was *late* & \"cold\" — 100% of it.\nA_b #1 cost $5.\n\n---\n\n\"Go,\" he said… “Now” – ‘then’."),
    (2, "# Chapter One\n\nOnly this."),
    (3, "##  Chapter Twenty-One — Dust\nx\n\n\n\ny"),
    (4, "no heading here\nand none here"),
    (5, "# Intro\n---\nA"),
    (6, ""),
    (7, "Prologue: Of Rain: twice\n\nHe did not stop. He had not slept.\nHe thought of home.\nHe did not."),
]

#: id, overall_fat_percentage, cuts of (quote, type, action, rewrite)
CUT_TEXTS = [
    (-1, "The old mill stood by the river and nobody went there. The old mill stood by the river at night.\n\n\n\nA lamp was lit in the upper window every evening. It was lit again."),
    (-2, "She counted the steps down  to the\nwater and found one more than before. Then she went home."),
    (-3, "Short text that stays whatever is asked of it."),
    (-4, "A lean text."),
]
CUTS = [
    (-1, 20, [("A lamp was lit in the upper window every evening.", "FAT", "CUT", None), ("The old mill stood by the river", "REDUNDANT", "CUT", None), ("upper window every evening. It was lit again.", "TELL", "CUT", None), ("too short", "FAT", "CUT", None)]),
    (-2, 30, [("She counted the steps down to the water", "OVER-EXPLAIN", "REWRITE", "She counted the steps"), ("a sentence that is nowhere to be found", "GENERIC", "CUT", None)]),
    (-3, 15, []),
    (-4, 5, [("A lean text that has more than it needs", "REDUNDANT", "CUT", None), ("and another one that is long enough", "REDUNDANT", "CUT", None)]),
    (-9, 50, [("a quote of a text that does not exist", "FAT", "CUT", None)]),
]
