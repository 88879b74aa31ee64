"""Word lists and pattern packs, as data."""

from __future__ import annotations

# The word lists, patterns, weights and limits below are what scores are defined by.

TIER1 = """
delve utilize leverage facilitate elucidate embark endeavor encompass multifaceted tapestry
paradigm synergy synergize holistic catalyze catalyst juxtapose myriad plethora
""".split()

TIER2 = """
robust comprehensive seamless seamlessly cutting-edge innovative streamline empower foster enhance elevate
optimize pivotal intricate profound resonate underscore harness cultivate bolster galvanize
cornerstone game-changer scalable
""".split()

OPENERS = "however furthermore additionally moreover nevertheless consequently nonetheless similarly".split()

TIER3 = [
    r"it'?s worth noting that",
    r"it'?s important to note that",
    r"^importantly,?\s",
    r"^notably,?\s",
    r"^interestingly,?\s",
    r"let'?s dive into",
    r"let'?s explore",
    r"as we can see",
    r"^furthermore,?\s",
    r"^moreover,?\s",
    r"^additionally,?\s",
    r"in today'?s .*(fast-paced|digital|modern)",
    r"at the end of the day",
    r"it goes without saying",
    r"when it comes to",
    r"one might argue that",
    r"not just .+, but",
]

TELLS = [
    r"a sense of \w+",
    r"couldn'?t help but feel",
    r"the weight of \w+",
    r"the air was thick with",
    r"eyes widened",
    r"a wave of \w+ washed over",
    r"a pang of \w+",
    r"heart pounded in (?:his|her|their) chest",
    r"(?:raven|dark|golden|silver) (?:hair|tresses) (?:spilled|cascaded|tumbled|fell)",
    r"piercing (?:blue|green|gray|grey|dark) eyes",
    r"a knowing (?:smile|grin|look|glance)",
    r"(?:he|she|they) felt a (?:surge|rush|wave|pang|flicker) of",
    r"the silence (?:was|hung|stretched|grew) (?:heavy|thick|oppressive|deafening)",
    r"let out a breath (?:he|she|they) didn'?t (?:know|realize)",
    r"something (?:dark|ancient|primal|unnamed) stirred",
]

TICS = [
    r"(?:I'm|I am) not (?:saying|asking|suggesting) .{3,40}(?:I'm|I am) (?:saying|asking|suggesting)",
    r"(?:which|that) means either .{3,40} or ",
    r"[Tt]here'?s a (?:difference|distinction)\.",
    r"[Tt]hose are (?:different|not the same) things\.",
    r"[Nn]ot (?:just|merely|simply) .{3,40}, but ",
    r"[Nn]ot (?:from|by|because of) .{3,40}, but (?:from|by|because)",
]

TELLING = [
    r"\b(?:he|she|they|I|we|[A-Z]\w+) (?:felt|was|seemed|looked|appeared) (?:angry|sad|happy|scared|nervous|excited|jealous|guilty|anxious|lonely|desperate|furious|terrified|elated|miserable|hopeful|confused|relieved|horrified|disgusted|ashamed|proud|bitter|defeated|triumphant)\b",
    r"\b(?:angrily|sadly|happily|nervously|excitedly|desperately|furiously|anxiously|guiltily|bitterly|wearily|miserably)\b",
]

WELLS = {
    "musical": """
        pitch tone interval chord note key octave fifth third fourth second seventh flat sharp harmonic
        resonance frequency vibration hum ring struck bell bells clapper tuning tuned tune scale melody
        rhythm beat measure rest composition composed sang sung sing singing voice voices choir acoustic
        acoustics sound sounds silence silent dissonance consonance resolution resolve resolving progression
        cadence tempo refrain notation codex fugue phrase
    """.split(),
    "trade": """
        bronze metal iron copper alloy forge lathe clapper gauge caliper oil linseed flux casting
        mold anvil hammer file workshop bench tools tool craft frame frames wax polish grain
        wood stone limestone coin coins contract contracts clause binding ratification petition ledger registry
        license licensed broker brokers merchant trade
    """.split(),
    "body": """
        eye eyes hand hands chest ribs jaw teeth tongue mouth throat shoulder shoulders back spine
        bone bones skin palm finger fingers thigh knee feet foot breath breathing pulse heart
        stomach gut temple temples skull wrist arm neck needle pain ache pressure tremor shaking
        shake shook steady still flinch tense tight cold warm heat sweat
    """.split(),
}

ABSTRACT = """
sense feeling notion concept idea quality nature essence aspect element factor presence absence weight gravity
meaning significance implication possibility certainty uncertainty awareness consciousness realization understanding
""".split()

VOICE_RULES = [
    "Body-first emotion (jaw, ribs, tongue before naming the feeling)",
    "No telling after showing",
    "No triadic sensory lists",
    "70%+ in-scene (dialogue and action, not summary)",
    "Dialogue: clipped, subtext-heavy, 'said' default, no adverb tags",
    "Sentence rhythm: mixed meter, fragments for pain, long for perception",
    "Vocabulary from craft/trade/body wells — no generic fantasy diction",
    "No paragraph-template-machine (vary structure)",
    "Max 1-2 em dashes per page",
]
