"""Fixed values.

Everything here is data that decisions depend on (labels, weights, word
patterns, limits), stated plainly so a result can be traced to a number. No
logic lives in this file. All text patterns apply to lower-cased, trimmed,
whitespace-collapsed text unless noted.
"""

# --- labels -------------------------------------------------------------

ASSISTANT = "assistant_directed"
HUMAN = "human_directed"
MEDIA = "background_or_media"
UNCERTAIN = "uncertain"
ADDRESSEES = (ASSISTANT, HUMAN, MEDIA)
GATE_LABELS = (ASSISTANT, HUMAN, MEDIA, UNCERTAIN)
ROUTES = ("act", "ignore", "escalate")
DECISION_SOURCES = ("system_one", "system_two")
OPEN_REQUEST = "open_request"
OTHER = "__other__"
CONTEXTS = ("awaiting_answer", "assistant_speaking", "timer_running")
SLOT_TYPES = ("duration", "number", "enum")
NEVER_SPOKEN = 1e9
DEFAULT_NAME = "Nova"

# --- provenance -----------------------------------------------------------

OPEN_LICENSES = ("Apache-2.0", "CC-BY-3.0", "CC-BY-4.0", "CC0-1.0",
                 "CDLA-Permissive-2.0", "MIT", "ODC-By-1.0", "PDDL-1.0")
CONSENT_SCOPES = ("release", "internal")

# (source, name, licence or None, url, attribution)
GATE_SOURCES = (
    ("ami", "AMI Meeting Corpus", "CC-BY-4.0", "https://groups.inf.ed.ac.uk/ami/corpus/",
     "AMI Meeting Corpus, AMI Consortium, CC BY 4.0"),
    ("common_voice", "Mozilla Common Voice", "CC0-1.0", "https://commonvoice.mozilla.org/",
     "Mozilla Common Voice, CC0 1.0 (do not attempt to identify speakers)"),
    ("speech_commands", "Google Speech Commands v0.02", "CC-BY-4.0",
     "https://arxiv.org/abs/1804.03209",
     "Speech Commands v0.02, P. Warden (Google), CC BY 4.0"),
    ("consented", "Consented recordings", "consent", "", ""),
    ("custom", "Other openly licensed data (licence column required)", None, "", ""),
    ("shadow_log", "Shadow-mode event log (evaluation only)", "none", "", ""),
)
# (source, name, licence or None, url, attribution, distributable or None = depends on the row)
CLIP_SOURCES = (
    ("synthetic_say", "Scripted lines voiced by a desktop voice", "Apple-SLA-personal", "", "",
     False),
    ("noise", "Generated noise (no speech)", "CC0-1.0", "", "", True),
    ("ami", "AMI Meeting Corpus (far-field array channel)", "CC-BY-4.0",
     "https://groups.inf.ed.ac.uk/ami/corpus/",
     "AMI Meeting Corpus, AMI Consortium, CC BY 4.0", True),
    ("speech_commands", "Google Speech Commands v0.02 (test set)", "CC-BY-4.0",
     "https://arxiv.org/abs/1804.03209",
     "Speech Commands v0.02, P. Warden (Google), CC BY 4.0", True),
    ("consented", "Consented recordings", "consent", "", "", None),
    ("custom", "Other openly licensed data (licence column required)", None, "", "", None),
)

# --- gate features ----------------------------------------------------------

PROSODY_NAMES = ("f0_mean", "f0_std", "f0_slope", "voiced_ratio", "spectral_centroid",
                 "spectral_rolloff", "spectral_tilt_log", "zcr", "pause_before")
FEATURE_NAMES = PROSODY_NAMES + (
    "duration", "vad_confidence", "p_own", "voice_confident", "is_wearer", "since_ai_log",
    "ignored_run", "accepted_recently", "awaiting_answer", "confirming", "offer_pending")
META_NAMES = ("label", "source", "license", "consent", "speaker", "session", "room", "mic",
              "feature_ms", "intent_verdict")
GROUP_KEYS = ("speaker", "session", "room", "mic")

GATE_WEIGHTS = {
    "bias": 1.2,
    "cold_conversation": -1.1,
    "very_cold_conversation": -0.7,
    "ignored_run": -0.55,
    "accepted_recently": 0.9,
    "not_wearer": -3.0,
    "very_long": -0.8,
    "very_short": -0.5,
    "low_vad_confidence": -0.6,
}
GATE_LIMITS = {
    "skip_below": 0.25, "cold_after": 20.0, "very_cold_after": 60.0, "ignored_run_cap": 3,
    "long_seconds": 10.0, "short_seconds": 1.2, "low_confidence": 0.90,
}
GATE_LICENSING = ("not_wearer", "very_long", "low_vad_confidence")

# --- addressee signals --------------------------------------------------------

SIGNAL_WEIGHTS = {
    "bias": -1.05,
    "assistant_name": 2.4, "assistant_name_mentioned": 0.45,
    "bystander_addressed": -2.2, "human_vocative": -1.1,
    "request_verb": 1.70, "question_lead": 0.60, "question_mark": 0.35,
    "knowledge_seeking": 0.80, "tool_domain": 0.90, "polite_request": 0.30,
    "human_discourse_lead": -0.65, "backchannel": -2.0,
    "social_register": -1.3, "joint_planning": -0.9, "reported_speech": -1.0,
    "third_person_about_ai": -0.8, "self_talk": -0.6,
    "physical_request": -1.6, "driving_browser": 1.5,
    "anaphoric_reference": 0.6, "human_exchange_in_progress": -0.45,
    "very_short_fragment": -0.9, "long_utterance": -0.5,
    "retry_of_ignored": 0.9, "unreliable_transcript": -1.4,
}
AUDIENCE_SIGNALS = ("bystander_addressed", "human_vocative", "social_register",
                    "joint_planning", "reported_speech", "third_person_about_ai",
                    "human_discourse_lead", "backchannel", "self_talk", "not_own_voice")
STRONG_POSITIVE = ("assistant_name", "assistant_name_mentioned", "request_verb",
                   "answering_ai_question", "tool_domain", "knowledge_seeking")

PATTERNS = {
    "question_lead":
        r"^(what|whats|what's|who|whos|who's|when|where|why|how|which|is|are|am|"
        r"can|could|would|will|should|do|does|did|has|have|tell|explain)\b",
    "request_verb":
        r"^(set|start|stop|cancel|pause|resume|remind|tell me|give me|show me|"
        r"look up|search|google|find out|calculate|compute|convert|translate|"
        r"define|spell|note|remember|add|time me)\b",
    "tool_domain":
        r"\b(timer|alarm|countdown|stopwatch|weather|forecast|temperature|"
        r"raining|humidity|what time|the time|the date|today's date|calculate|"
        r"plus|minus|times|divided by|percent of|square root|convert|"
        r"celsius|fahrenheit|kilometers|miles|kilograms|pounds)\b",
    "knowledge_seeking":
        r"\b(capital of|population of|who is|who was|who's a|who's the|"
        r"whos a|whos the|what is|what's the|"
        r"how many|how much|how far|how long|how old|difference between|"
        r"meaning of|definition of|when did|when was|where is)\b",
    "polite_request": r"\b(please|could you|can you|would you mind)\b",
    "backchannel":
        r"^(yeah|yep|yup|nope|nah|no|ok|okay|k|right|sure|mhm|mm|hmm|huh|uh huh|"
        r"cool|nice|wow|oh|ah|aw|haha|hah|lol|exactly|totally|true|fair|"
        r"i know|i see|got it|for sure|no way|oh my god|jesus|damn)"
        r"[\s,.!?]*$",
    "human_vocative":
        r"\b(dude|bro|man|mate|guys|y'all|yall|folks|honey|babe|sweetie|"
        r"mom|mum|dad|sis|bruh)\b",
    "human_discourse_lead":
        r"^(yeah|yep|yup|nah|nope|oh|ah|aw|haha|hah|lol|well|i mean|like|honestly|"
        r"actually|wait|dude|man|bro|okay so|ok so|anyway|besides)\b",
    "social_register":
        r"\b(how are you|how've you been|how was your|how'd it go|did you see|"
        r"did you hear|are you free|you free|wanna grab|want to grab|see you|"
        r"talk to you later|catch you later|good to see you|nice to meet you|"
        r"congrats|congratulations|happy birthday|thank you so much)\b",
    "joint_planning":
        r"\b(let's|lets |shall we|should we|we should|do you wanna|do you want to|"
        r"you wanna|are we|we could|we'll|our )\b",
    "reported_speech":
        r"\b(he|she|they) (said|told|asked|replied|mentioned|goes|was like)\b"
        r"|\bi told (him|her|them)\b"
        r"|\b(apparently|supposedly|reckons)\b",
    "third_person_about_ai":
        r"\b(the ai|my assistant|the assistant|this thing|the bot|it said|"
        r"it told me|i asked it|it thinks|the model)\b",
    "self_talk":
        r"^(where did i|where's my|where is my|i need to|i should|i forgot|"
        r"note to self|god i|ugh|oh no|oh shoot|oh crap)\b",
    "anaphoric_reference":
        r"\b(it|its|that one|this one|those|these|them|the (?:first|second|third|"
        r"last|other|next|cheaper|bigger|smaller) one|the other|the same)\b",
    "physical_request":
        r"(?<!\bto\s)\b(pass|hand|grab|carry|fetch|"
        r"hold(?!\s+(?:on|that\s+thought|tight|fire|still|steady|your\s+horses)\b)|"
        r"pick\s+(?:it|that|this|them|those)\s+up|"
        r"put\s+(?:it|that|this|them)\s+(?:down|back|over|there|here|away)|"
        r"throw|shut\s+the\s+(?:door|window|curtains)|"
        r"open\s+the\s+(?:door|window|curtains|fridge|box|bottle|jar))\b",
    "driving_browser":
        r"^(?:ok(?:ay)?|then|now|and|no|yes|yeah|right|please)?[,\s]*"
        r"(?:can\s+you\s+|could\s+you\s+)?"
        r"(click|press|tap|select|choose|scroll|swipe|zoom|"
        r"skip|rewind|replay|mute|unmute|fullscreen|pause|resume|"
        r"go\s+back|go\s+forward|back\s+to|next|previous|"
        r"the\s+(?:first|second|third|last|other|next|previous)\s+one|"
        r"that\s+(?:button|link|tab|video)|"
        r"type\s|search\s+for|open\s+the|close\s+the\s+tab)\b",
    "driving_polite_lead":
        r"^(?:ok(?:ay)?|then|now|and|no|yes|yeah|right)?[,\s]*"
        r"(?:please\s+)?(?:can|could|would|will)\s+you\s+",
    "driving_somebody_else":
        r"\b(you|your|yours|we|we'?re|we'?ll|us|let'?s|she|he|they|them|"
        r"i'?ll|i'?m|i\s+need|i\s+want|somebody|someone)\b",
    "vocative_lead":
        r"^\s*(?:(?:hey|hi|hello|ok|okay|yo|um|uh|so|excuse me|sorry)[\s,]+)*$",
    "last_sentence": r"(?sU)^.*[.!?](?=[ \t\n\x0B\f\r])\s*(\S(?:.*\S)?)",
    "wants_repeat":
        r"\b(?:what|sorry)[,\s]*(?:did|was)\s+(?:you|that)\b"
        r"|\bsay\s+(?:that|it)\s+again\b"
        r"|\bsay\s+again\b"
        r"|\brepeat\s+(?:that|it|yourself)?\b"
        r"|\bcome\s+again\b"
        r"|\bi\s+(?:did\s*n[o']?t|missed|couldn'?t)\s+(?:catch|hear|get)\s+(?:that|you|it)\b"
        r"|\bone\s+more\s+time\b",
    "wants_more_detail":
        r"\btell\s+me\s+more\b"
        r"|\b(?:go|carry)\s+on\b"
        r"|\bmore\s+detail\b|\bin\s+more\s+detail\b"
        r"|\bexpand\s+on\s+(?:that|it|this)\b"
        r"|\belaborate\b"
        r"|\bwhat\s+else\b"
        r"|\bthe\s+long\s+version\b"
        r"|\bkeep\s+going\b",
}

#: Letters that a match of an unanchored pattern can begin with: other places need not be tried.
LEADS = {
    "tool_domain": "tacswfrhpmdk", "knowledge_seeking": "cpwhdm", "polite_request": "pcw",
    "human_vocative": "dbmgyfhs", "social_register": "hdaywstcgn", "joint_planning": "lswdyao",
    "reported_speech": "hstiar", "third_person_about_ai": "tmi", "physical_request": "phgcftso",
    "anaphoric_reference": "it",
}
FOLLOWUP_FILLER = ("ok", "okay", "right", "so", "well", "hmm", "um", "uh", "please", "then",
                   "now", "yeah", "and", "a", "the", "bit", "little", "just", "can", "you",
                   "sorry")

STOPWORDS = tuple("""
a an the and or but if then than that this these those there here it its is
are was were be been being am do does did doing have has had having will
would shall should can could may might must i you he she we they me him her
us them my your his their our of in on at to for with from by about as into
like through after over between out against during without before under
around among not no yes so very just really quite too also only even still
some any all both each few more most other another such own same what which
who whom when where why how one two three thing things get got go going
know think say said tell told good bad well now new old
""".split())
NOT_PLURAL_ENDINGS = ("ss", "us", "is", "os", "as")

# --- transcript parsing -----------------------------------------------------------

POLITE_LEAD = (r"^(?:(?:please|ok(?:ay)?|hey|oh|um+|uh+|so|and|right|alright|well)\s+)*"
               r"(?:(?:can|could|would|will) you\s+(?:please\s+)?|i want you to\s+|"
               r"i'?d like you to\s+)?")
POLITE_TAIL = r"\s+(?:please|thanks|thank you|for me)$"

NUMBER_WORDS = {
    "zero": 0, "a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4,
    "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15,
    "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19,
}
TENS_WORDS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60,
              "seventy": 70, "eighty": 80, "ninety": 90}

DURATION_NUMBER = (
    r"(?:\d+(?:\.\d+)?|(?:twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety)"
    r"(?:[ -](?:one|two|three|four|five|six|seven|eight|nine))?|"
    r"zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|"
    r"thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|an?)")
DURATION_UNIT = r"(?:hours?|hrs?|minutes?|mins?|seconds?|secs?)"
DURATION_AMOUNT = (r"\b(" + DURATION_NUMBER + r")(\s+and\s+a\s+half)?\s+(" + DURATION_UNIT +
                   r")(\s+and\s+a\s+half)?\b")
DURATION_THREE_QUARTERS = r"\bthree\s+quarters\s+of\s+an\s+hour\b"
DURATION_HALF_UNIT = r"(?<!and a )\bhalf\s+(?:an?\s+)?(hour|minute)\b"
DURATION_QUARTER_HOUR = r"\b(?:a\s+)?quarter\s+(?:of\s+)?an?\s+hour\b"

# Ordered: the first rule whose pattern is found wins.
INTENT_RULES = (
    ("timer.cancel",
     r"\b(?:cancel|stop|kill|delete|turn off|end)\s+(?:the\s+|my\s+|that\s+)?timer\b"),
    ("timer.set",
     r"\b(?:set|start|make|put on)\s+(?:a|an|the|me a)?\s*.*\btimer\b|"
     r"\btimer\s+(?:for|of)\b|\bcount\s*down\b|\bcountdown\b"),
    ("time.now",
     r"\bwhat(?:'s| is)\s+the\s+time\b|\bwhat\s+time\s+is\s+it\b|"
     r"\btell\s+me\s+the\s+time\b|\bgot\s+the\s+time\b"),
    ("stop",
     r"^(?:stop|stop it|stop talking|stop that|okay stop|that'?s enough|enough|shush|shh+|"
     r"be quiet|quiet|silence|shut up|stop stop)$"),
    ("cancel",
     r"^(?:never ?mind|cancel|cancel that|cancel it|forget it|forget that|scratch that|"
     r"don'?t worry about it)$"),
    ("repeat",
     r"^(?:sorry\s+)?(?:say (?:that|it) again|repeat (?:that|it)|"
     r"what did you say|come again|pardon|sorry what|"
     r"can you repeat (?:that|it)|one more time)$"),
    ("volume.up",
     r"^(?:a (?:bit|little) )?louder$|\bturn (?:it|the volume|that) up\b|"
     r"\bvolume up\b|\b(?:increase|raise) the volume\b|^louder please$"),
    ("volume.down",
     r"^(?:a (?:bit|little) )?(?:quieter|softer)$|"
     r"\bturn (?:it|the volume|that) down\b|\bvolume down\b|"
     r"\b(?:decrease|lower|reduce) the volume\b"),
    ("media.pause",
     r"^(?:pause|pause it|pause that|pause the music|pause playback|pause the podcast|"
     r"hold on pause)$"),
    ("media.resume",
     r"^(?:resume|play|carry on|unpause|keep playing|continue|continue playing|"
     r"resume playback|play it again|go on)$"),
    ("confirm.yes",
     r"^(?:yes|yeah|yep|yup|yes please|sure|go ahead|do it|please do|do|ok(?:ay)?|"
     r"sounds good|yeah go ahead|yes do it|absolutely|of course|yeah sure|go for it)$"),
    ("confirm.no",
     r"^(?:no|nope|nah|no thanks|no thank you|don'?t|leave it|no leave it|don'?t bother|"
     r"no don'?t|not now)$"),
)

# --- the core intent catalogue --------------------------------------------------------

TIMER_DURATIONS = (30, 60, 90, 120, 180, 240, 300, 360, 420, 480, 540, 600, 720, 900,
                   1200, 1500, 1800, 2400, 2700, 3600, 5400, 7200)
OFF_LIST_DURATIONS = (45, 150, 200, 660, 780, 1080, 1320, 3000, 4200, 10800)

CORE_INTENTS = (
    {"name": "stop", "description": "stop talking or stop what is playing",
     "examples": ["stop", "stop it", "that's enough", "okay stop", "shush"]},
    {"name": "cancel", "description": "drop the current request",
     "examples": ["never mind", "cancel that", "forget it", "cancel"]},
    {"name": "confirm.yes", "description": "answer yes to the assistant's question",
     "examples": ["yes", "yeah", "yes please", "go ahead", "sure", "do it"],
     "when": ["awaiting_answer"]},
    {"name": "confirm.no", "description": "answer no to the assistant's question",
     "examples": ["no", "no thanks", "nope", "don't", "no, leave it"],
     "when": ["awaiting_answer"]},
    {"name": "repeat", "description": "say the last answer again",
     "examples": ["say that again", "repeat that", "what did you say", "come again"]},
    {"name": "volume.up", "description": "louder",
     "examples": ["louder", "turn it up", "volume up", "a bit louder"]},
    {"name": "volume.down", "description": "quieter",
     "examples": ["quieter", "turn it down", "volume down", "a bit quieter"]},
    {"name": "media.pause", "description": "pause playback",
     "examples": ["pause", "pause it", "pause the music"]},
    {"name": "media.resume", "description": "resume playback",
     "examples": ["resume", "play", "carry on", "unpause", "keep playing"]},
    {"name": "time.now", "description": "tell the time",
     "examples": ["what time is it", "what's the time", "tell me the time"]},
    {"name": "timer.set", "description": "start a countdown timer",
     "examples": ["set a timer for {duration}", "timer for {duration}",
                  "start a {duration} timer", "countdown {duration}"],
     "slots": [{"name": "duration", "type": "duration",
                "values": list(TIMER_DURATIONS), "required": True}]},
    {"name": "timer.cancel", "description": "cancel the running timer",
     "examples": ["cancel the timer", "stop the timer", "kill the timer"],
     "when": ["timer_running"]},
)

# --- threshold search ----------------------------------------------------------------

ACT_GRID = (0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.93, 0.95, 0.97, 0.98, 0.99)
SWEEP_COLUMNS = (
    "encoder", "targets", "hidden", "seed", "rows_holdout", "stt_avoided", "act", "ignore",
    "escalate", "false_ignore", "false_ignore_up95", "false_activation",
    "false_activation_up95", "wrong_act", "typed_acted", "addressed_acc", "addressed_auc",
    "addressed_ece", "intent_acc", "slot_acc", "hybrid_correct", "teacher_correct",
    "encode_ms_p50", "real_addressed_acc", "synthetic_addressed_acc")
REAL_SOURCES = ("ami", "speech_commands", "consented")
SYNTHETIC_SOURCES = ("synthetic_say", "noise")
