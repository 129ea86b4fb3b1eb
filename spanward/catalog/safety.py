"""Safety rules."""

GUARD_ORDER = ["jailbreak", "toxicity", "prompt_injection"]
DEFAULT_ENABLED = {"jailbreak": True, "toxicity": True, "prompt_injection": True}
DEFAULT_ACTIONS = {"jailbreak": "BLOCK", "toxicity": "BLOCK", "prompt_injection": "BLOCK"}

# Jailbreak patterns, tried in this order.
JAILBREAK = [
    r"\bDAN\b",
    r"do anything now",
    r"jailbreak",
    r"ignore (all )?(previous|prior|above|your) (instructions?|prompts?|guidelines?|rules?|constraints?)",
    r"disregard (all )?(previous|your) (instructions?|rules?|prompts?|guidelines?)",
    r"forget (all )?(previous|prior|your) (instructions?|rules?|prompts?|guidelines?)",
    r"override (your )?(instructions?|guidelines?|rules?|training)",
    r"pretend (you are|you're|to be) (a|an) (?!assistant|AI).{0,40} (no restrictions|no limits|unrestricted|without (any )?restrictions)",
    r"act as (if you have|though you have) no (restrictions|limitations|guidelines|rules|safety)",
    r"(you are|you're) now (a|an) (unrestricted|uncensored|unfiltered|evil|bad|rogue)",
    r"you have no (restrictions|limitations|guidelines|rules|safety|ethical)",
    r"(enable|activate|switch (to|on)) (developer|dev|god|admin|maintenance|unsafe|unrestricted) mode",
    r"(you are|you're) (freed?|liberated) from (your )?(restrictions?|limitations?|guidelines?|safety)",
    r"respond (without|with no) (filters?|restrictions?|limitations?|guidelines?|censorship)",
    r"(bypass|circumvent|override|ignore|remove) (your )?(safety|content|ethical) (filters?|checks?|restrictions?|guidelines?)",
    r"\[SYSTEM\].*ignore",
    r"<\|im_start\|>system",
    r"<\|system\|>",
    r"###\s*(instruction|system|override)",
    r"prompt\s*injection",
    r"you must (obey|follow|comply with|do) (everything|anything|all) (i|the user)",
    r"(your|the) (new|real|true|actual) (instructions?|purpose|goal|role|identity|name) (is|are)",
    r"from now on (you are|you will|ignore)",
    r"i (hereby|now|officially) (grant|give) you (permission|authority|freedom)",
    r"simulate (an|a) ?(AI|chatbot|LLM|GPT|assistant) (without|with no|that has no)",
    r"no (ethical|moral) (guidelines?|constraints?|restrictions?|considerations?)",
    r"(evil|malicious|hacked|broken|glitched|corrupted) (AI|bot|model|GPT|assistant)",
]

# Toxicity severe patterns, tried in this order.
TOXICITY_SEVERE = [
    r"\bi will (kill|murder|rape|torture|harm|destroy|attack) (you|them|him|her)\b",
    r"\b(kill|murder|rape|torture|bomb|shoot|stab) (yourself|yourself|them|him|her)\b",
    r"(go|just) (kill|hang) yourself",
    r"\b(n[i1]gg[ae]r|f[a4]gg[o0]t|ch[i1]nk|sp[i1]c|k[i1]ke|w[e3]tb[a4]ck)\b",
    r"\b(i('ll| will| am going to) (blow up|shoot up|bomb))\b",
    r"suicide (method|how to|tutorial|guide|instructions?)",
    r"(how (to|do i) (make|build|create|synthesize) (a |an )?(bomb|explosive|poison|bioweapon|nerve agent))",
    r"(child|minor|underage).{0,20}(porn|sex|nude|naked|explicit)",
]

# Toxicity strong patterns, tried in this order.
TOXICITY_STRONG = [
    r"\b(you('re| are) (a |an )?(worthless|pathetic|disgusting|vile|filthy) (piece of shit|scum|trash|garbage))\b",
    r"\b(hate|despise|loathe) (all )?(jews?|muslims?|christians?|blacks?|whites?|asians?|women|men|gays?|lesbians?)\b",
    r"\b(death|violence) to (all )?(jews?|muslims?|christians?|blacks?|gays?|immigrants?)\b",
    r"\b(sexual(ly)? (harass|assault|abuse|exploit))\b",
    r"\bself(-| )(harm|mutilat|injur)\b",
]

# Prompt injection patterns, tried in this order.
PROMPT_INJECTION = [
    r"<\|im_start\|>",
    r"<\|im_end\|>",
    r"<\|system\|>",
    r"<\|user\|>",
    r"<\|assistant\|>",
    r"\[INST\]",
    r"\[/INST\]",
    r"<<SYS>>",
    r"<</SYS>>",
    r"<s>.*</s>",
    r"(new|updated?|revised?|override) (system )?instructions?:",
    r"(ignore|discard|forget|override).{0,30}(above|previous|prior|original) (instructions?|context|system prompt)",
    r"you are now (operating|running|functioning) (as|under|in)",
    r"system prompt:",
    r"(your|the) (system|real|hidden|secret|actual|true) (prompt|instructions?|directive|role):",
    r"```\s*(system|SYSTEM|System)",
    r"<system>",
    r"\[system\]",
    r"---\s*(system|override|instructions?)\s*---",
    r"(inject|exfiltrate|leak|extract).{0,30}(prompt|instructions?|system|context)",
    r"(print|output|display|reveal|show|tell me|repeat|echo).{0,40}(system prompt|your instructions?|your prompt|your context)",
    r"translate the above\s*(prompt|instruction|text|context)\s*to",
    r"(summarize|restate|repeat).{0,20}(the )?(system|initial|original) (prompt|instructions?)",
    r"escape.{0,20}(sandbox|container|context|system)",
    r"execute\s+(arbitrary|external|user-provided)\s+(code|commands?|instructions?)",
]

# The reason given for a hit.
JAILBREAK_REASON = "Jailbreak attempt detected: matched pattern '{}'"
SEVERE_REASON = "Severe toxic content detected (threats / hate speech / CSAM)"
STRONG_REASON = "Strongly toxic content detected (hate speech / harassment)"
INJECTION_REASON = "Prompt injection attempt detected: matched '{}'"
REASON_PATTERN_CHARS = 60


def rules() -> list[tuple[str, str, int, str, str]]:
    """(guard, tier, ord, pattern, reason) in evaluation order."""
    cut = REASON_PATTERN_CHARS
    out = [("jailbreak", "any", p, JAILBREAK_REASON.format(p[:cut])) for p in JAILBREAK]
    out += [("toxicity", "severe", p, SEVERE_REASON) for p in TOXICITY_SEVERE]
    out += [("toxicity", "strong", p, STRONG_REASON) for p in TOXICITY_STRONG]
    out += [("prompt_injection", "any", p, INJECTION_REASON.format(p[:cut])) for p in PROMPT_INJECTION]
    return [(guard, tier, i, p, reason) for i, (guard, tier, p, reason) in enumerate(out)]
