"""Lists, patterns and texts that results depend on, as plain text in their natural order."""

# English stop words.
STOP_WORDS = """
a about above after again against all am an and any are aren't as at be because been before being below between both but by can't
cannot could couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't has hasn't have
haven't having he he'd he'll he's her here here's hers herself him himself his how how's i i'd i'll i'm i've if in into is isn't it
it's its itself let's me more most mustn't my myself no nor not of off on once only or other ought our ours ourselves out over own
same shan't she she'd she'll she's should shouldn't so some such than that that's the their theirs them themselves then there
there's these they they'd they'll they're they've this those through to too under until up very was wasn't we we'd we'll we're we've
were weren't what what's when when's where where's which while who who's whom why why's with won't would wouldn't you you'd you'll
you're you've your yours yourself yourselves
""".split()

# Words that carry nothing in a question.
QUESTION_STOP_WORDS = "what is the of this paper how why in to a an does do and or for are tell me about can you which who whom where when there".split()

# What a line must look like to be a heading, and the taxonomy of headings, the first match counting.
HEADING = r"^([0-9]+\.?[0-9]*\.?\s+)?[A-Z][A-Za-z\s\-:&/]{2,60}$"
HEADINGS = [
    ("abstract", r"^abstract$|^summary$"),
    ("introduction", r"^introduction$|^1\.\s*introduction|^overview$"),
    ("related_work", r"^related\s+work|^literature\s+review|^background|^prior\s+work|^previous\s+work|^state\s+of\s+the\s+art"),
    ("methodology", r"^method|^methodology|^approach|^proposed\s+(method|approach|framework|model)|^(system\s+)?design|^experimental\s+setup|^materials\s+and\s+methods"),
    ("experiments", r"^experiment|^evaluation|^empirical|^benchmark|^setup"),
    ("results", r"^results?$|^findings?$|^performance|^quantitative\s+results"),
    ("discussion", r"^discussion|^analysis|^ablation|^qualitative\s+analysis"),
    ("conclusion", r"^conclusion|^concluding\s+remarks|^summary\s+and\s+conclusion|^future\s+work"),
    ("references", r"^references?$|^bibliography$|^works\s+cited"),
    ("acknowledgments", r"^acknowledge?ment|^thanks"),
    ("appendix", r"^appendix|^supplementary"),
]

# Other names under which a section is looked up, and how many characters of each count.
ALIASES = {"results": ["results", "experiments"]}
SECTION_CAPS = {"abstract": 3000, "introduction": 3000, "methodology": 4000, "experiments": 2000, "results": 3000, "discussion": 3000, "conclusion": 3000}
COMBINED_CAP = 8000

# Characters that are written out, and those that are replaced one by one.
LIGATURES = [("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")]
QUOTES, PLAIN_QUOTES = "‘’“”–—­", "''\"\"--"

# Cue phrases.
OBJECTIVE = [
    r"(?:this paper|this work|this study|we)\s+(?:propose|present|introduce|aim|investigate|address|focus on|explore)\s+([^.]{30,200}\.)",
    r"(?:the|our)\s+(?:goal|objective|purpose|aim)\s+(?:of this (?:paper|work|study)\s+)?(?:is|was)\s+(?:to\s+)?([^.]{30,200}\.)",
    r"in this (?:paper|work|study),?\s+(?:we\s+)?([^.]{30,200}\.)",
]
METHOD = [
    r"(?:we\s+)?(?:use|employ|adopt|propose|develop|design|implement)\s+([^.]{20,200}\.)",
    r"(?:our\s+)?(?:approach|method|framework|model|architecture|algorithm)\s+(?:is|consists of|involves|uses)\s+([^.]{20,200}\.)",
    r"(?:based on|using|with)\s+([^.]{20,200}\.)(?:\s+we)",
]
FINDING = [
    r"(?:our|the)\s+(?:results?|experiments?|evaluation|findings?|analysis)\s+(?:show|demonstrate|indicate|reveal|suggest)\s+([^.]{20,200}\.)",
    r"(?:we\s+)?(?:find|found|observe|observed|show|showed|demonstrate|demonstrated)\s+(?:that\s+)?([^.]{20,200}\.)",
    r"(?:outperform|achieve|improve|accuracy|f1|precision|recall|bleu|rouge)[^.]{10,200}\.",
]
CONTRIBUTION = [
    r"(?:our\s+)?(?:main|key|primary|novel|principal)\s+(?:contribution|contributions?)\s+(?:is|are|include)\s+([^.]{30,300}\.)",
    r"(?:we\s+)?contribute\s+(?:by\s+)?([^.]{30,200}\.)",
    r"(?:to the best of our knowledge|for the first time),?\s+([^.]{20,200}\.)",
    r"(?:novel|new|improved|state.of.the.art)\s+([^.]{20,200}\.)",
]
LIMITATION = [
    r"(?:one\s+)?(?:limitation|drawback|weakness|shortcoming|constraint)\s+(?:of\s+(?:our|this|the)\s+(?:work|approach|method|study)\s+)?(?:is|are)\s+([^.]{20,200}\.)",
    r"(?:our\s+)?(?:approach|method|model)\s+(?:does not|cannot|fails to|is limited)\s+([^.]{20,200}\.)",
    r"(?:future\s+work|future\s+research)\s+(?:should|could|may|might|would)\s+([^.]{20,200}\.)",
    r"(?:we\s+)?(?:did not|do not)\s+(?:address|consider|explore|handle)\s+([^.]{20,200}\.)",
]
DATASET = [
    r"(?:dataset|corpus|benchmark|data)\s+(?:called|named|known as)?\s*([A-Z][A-Za-z0-9\-_]+(?:\s+[A-Z0-9][A-Za-z0-9\-_]+){0,3})",
    r"(?:we\s+)?(?:use|evaluate|train|test)\s+(?:on|with)\s+(?:the\s+)?([A-Z][A-Za-z0-9\-_]+(?:\s+[A-Z0-9][A-Za-z0-9\-_]+){0,3})\s+(?:dataset|benchmark|corpus)",
    r"([A-Z][A-Za-z0-9\-_]+(?:\s+[A-Z0-9][A-Za-z0-9\-_]+){0,3})\s+(?:dataset|benchmark)",
]
FUTURE = [
    r"(?:future\s+work|future\s+research|in\s+the\s+future)\s+(?:should|could|will|may|might|would|can)\s+([^.]{20,200}\.)",
    r"(?:an?\s+)?(?:interesting|promising|open|important)\s+(?:direction|avenue|challenge|question|problem)\s+(?:for\s+future\s+(?:work|research)\s+)?(?:is|would be)\s+([^.]{20,200}\.)",
    r"(?:remain|remains)\s+(?:an?\s+)?(?:open\s+)?(?:challenge|question|problem|issue)\s+([^.]{10,200}\.)",
    r"(?:we\s+)?(?:did not|do not)\s+(?:address|consider|explore)\s+([^.]{20,150}[,;])",
    r"(?:one\s+limitation|a\s+limitation)\s+(?:of\s+(?:this|our)\s+(?:work|approach|study)\s+)?(?:is\s+that\s+)?([^.]{20,200}\.)",
]

# Words that speak for a domain, domains in order of precedence, and the domain of a text without any.
DOMAINS = [
    ("Natural Language Processing", ["nlp", "language model", "text", "bert", "gpt", "transformer", "sentiment", "named entity", "machine translation", "summarization"]),
    ("Computer Vision", ["image", "object detection", "cnn", "convolutional", "visual", "segmentation", "recognition", "video", "pixel"]),
    ("Machine Learning", ["machine learning", "neural network", "deep learning", "classification", "regression", "gradient", "overfitting", "training"]),
    ("Reinforcement Learning", ["reinforcement learning", "reward", "agent", "policy", "q-learning", "environment"]),
    ("Graph Learning", ["graph neural", "gnn", "knowledge graph", "node", "edge", "graph convolutional"]),
    ("Bioinformatics", ["protein", "gene", "dna", "rna", "genomic", "biological", "sequence"]),
    ("Robotics", ["robot", "autonomous", "navigation", "manipulation", "sensor", "actuator"]),
    ("Data Mining", ["data mining", "pattern", "clustering", "association rule", "anomaly detection"]),
]
NO_DOMAIN = "Computer Science"

# Messages.
NO_SUMMARY = "Insufficient text to generate summary."
NO_CONTEXT = "I could not find enough information in the uploaded paper."
NO_ANSWER = "I could not find a confident answer to this question in the uploaded paper."
NO_TITLE = "Unknown Title"
NO_RELEVANT = "I could not find relevant content in the uploaded paper to answer this question."
SCANNED = (
    "This PDF appears to be scanned or image-based (avg ",
    " chars/page). Text extraction quality may be poor. OCR is not available.",
)
UNKNOWN_SECTION = "unknown"
# Why a file gives no pages; the file's name, or what the extractor says, stands after or between these.
NOT_FOUND = "PDF file not found: "
NOT_PDF = "File is not a PDF: "
NOT_OPENED = ("Cannot open PDF '", "': ")
NO_PAGES = ("PDF '", "' contains no pages.")
EXPLICIT_REASON = "Explicitly mentioned in the paper as future work."
LIMITATION_REASON = "This limitation was identified in the paper and represents a gap to fill."

# Patterns that question a statement of future work anew, and the words that questions and topics begin with.
FUTURE_START = r"(?:future\s+work|future\s+research)\s+(?:should|could|will|may|might|would|can)\s+"
ACTOR_START = r"^(?:we|one)\s+(?:could|should|might)\s+"
ASKED = "Could researchers "
ADDRESSING = "Addressing: "
OVERCOME = ("How can the limitation — '", "'— be overcome?")
EXTENDING = ("Extending ", " approaches")

# What stands around a running head or foot, and a lone page number.
RUNNING_LINE = r"^.{0,80}(page\s+[0-9]+\s+of\s+[0-9]+|doi:\s*10\.[0-9]+|©\s*[0-9]{4}|all rights reserved).{0,80}$"
PAGE_NUMBER_LINE = r"^\s*[0-9]{1,4}\s*$"
REFERENCES_LINE = r"\n\s*(references|bibliography|works\s+cited)\s*\n"
BLOCK_END = r"[^\p{L}\p{N}_\s'\-]+"
DOI = r"10\.[0-9]{4,}/\S+"
YEAR = r"\b(19|20)[0-9]{2}\b"
ABSTRACT_START = r"\bAbstract\b[\s:—\-]*\n?(.*?)"
ABSTRACT_END = r"\n\n|\n[A-Z][A-Za-z\s]{2,40}\n"

# Questions that are suggested for every paper.
QUESTIONS = [
    "What is the main objective of this paper?",
    "What dataset was used?",
    "What methodology did the authors use?",
    "What are the main findings?",
    "What are the limitations?",
    "What is the key contribution?",
    "What future work is suggested?",
    "Explain the methodology simply.",
]
