"""Word lists and patterns of the term extractor and of the name rules. All are parameters; these are the defaults.

Fixed values: every list and pattern below must hold these very words, or results differ.
"""

#: Words that cut a text into chunks, function words and academic fillers.
BOUNDARY = frozenset(
    """a an the of for and or nor but if then than so as at by in on to into onto from with within without via per
    is are was were be been being am do does did done has have had having can could may might must shall should will would
    this that these those it its they them their there here we our us you your he she his her i me my who whom whose which
    what when where why how whether while also both each either neither every all any some such no not only own same other
    about above below between among across after before during through throughout toward towards under over up down out off
    more most less least very too much many few further again once just even still yet already however thus hence therefore
    new novel proposed propose proposes present presents presented study studies paper work works approach approaches method
    methods using use uses used based via improved improving improve improves enhanced enhancing enhance
    efficient effective robust simple scalable comprehensive systematic review survey overview analysis analyses investigation
    case evaluation evaluating evaluate results result finding findings role impact impacts effect effects application applications
    applying applied challenges challenge opportunities opportunity perspective perspectives future current recent state art
    framework frameworks design designing designed development developing developed implementation implementing
    et al vs versus etc one two three first second third
    against like unlike beyond despite near around along upon amid state_of_the_art""".split()
)

#: Modifiers that can't begin a phrase and common words that can't end one.
START_BAD = frozenset(
    """large small big high low general generic various several different multiple single key main important significant
    based driven enabled powered aware oriented real specific certain particular potential possible typical common standard
    end_to_end""".split()
)
END_BAD = frozenset(
    """based driven enabled powered aware oriented level scale time times data information task tasks problem problems
    issue issues performance accuracy quality efficiency cost costs process processes way ways setting settings""".split()
)

#: A phrase of these words only isn't a technology's name.
GENERIC = frozenset(
    """ai artificial intelligence machine learning deep neural network networks model models system systems data method methods
    approach framework algorithm algorithms learning based analysis application applications technology technologies research
    study results performance proposed paper information computer science computing process processing management design
    development problem problems task tasks time real use using case new novel different various high low large small""".split()
)

#: First and last words of fragments, and terms that begin like one but aren't.
FRAGMENT_START = frozenset(
    """time world real resource train scale native order assisted driven aware based enabled powered rich free shot end loop
    source grade level wide like term contact grained specific agnostic efficient invariant unit gold backed frontier class
    efficiently linking context latency leveraging integrating enabling using building towards toward improving enhancing
    accelerating scaling making multi hardware unlocking parsing accelerate playing facing turning powering modal rethinking
    measuring strengthen accurate utilizing understanding connecting bridging running teaming sensing inferring preventing
    cost bandwidth tailed""".split()
)
FRAGMENT_END = frozenset(
    """assisted agentic robotic financial real rich driven aware based free massive enabled powered native secure open deep co
    enables wrong llm robot mobile self class augmented specific backed guided integrated llama actually don doesn writes write
    just really still now need works make makes get gets want think can will should going built made large multi aligned
    extension access consensus transformer_based multimodal embodied autonomous generative conversational scientific
    mathematical cryptographic visual spatial geometric kinematic dexterous personalized predictive generated controlled
    conditioned informed neutral early en efficiently exposed social cyber mental romantic detailed heuristic offensive
    institutional systemic regulated explicit diverse generalized consistent foundational minimal verifiable unified
    generalizable convolutional interactive hidden fractional high millions world bypass scoped""".split()
)
FRAGMENT_FINE = ("time series", "zero shot", "end to end", "real world asset", "scale out", "order book", "source code", "loop closure", "cost aware", "cost effective", "cost efficient")
#: Heads and common words of umbrella phrases.
UMBRELLA_HEADS = frozenset("ai agentic llm llms agent agents genai generative intelligent".split())
UMBRELLA_WORDS = frozenset(
    """systems system platform platforms pipeline pipelines advisors assets concierge discovery os runtime infrastructure
    governed model models workloads clusters applications solutions tools services era adoption technology technologies
    compliant combining strategic native production enterprise personal research inference forecast engine stack ecosystem
    economy future development integration capabilities innovation transformation governance risk assessment assistants
    assistant open source scale secure latency powered building architecture workflows workflow protocols context aware non
    deterministic extension driven access coding multi infra malicious offensive vulnerability vulnerabilities""".split()
)

#: Fixed value: names of standards and protocols; with the numbered publications of one more body they exclude.
_NUMBERED = r"v?\d+\.\d+|version \d|rfc ?\d+|{more}ieee ?\d|iso ?\d|iec ?\d|3gpp|etsi|w3c|oasis|ietf"
_NAMED = r"protocol|protocols|standard|standards|specification|spec|interconnect express|ethernet|wi-?fi \d|bluetooth|usb|hdmi|pcie|pci express|nvlink|cxl|ucie|uefi|onnx|openapi|a2a|mcp"
STANDARD = rf"\b({_NUMBERED.format(more='')})\b|\b({_NAMED})\b"
EXCLUDED_STANDARD = rf"\b({_NUMBERED.format(more='fips ?[0-9]+|')})\b|\b({_NAMED})\b"
#: Fixed value: punctuation that ends a piece of text.
PIECE_BREAK = r"""[.,;:!?()\[\]{}"'“”‘’/\\|<>=+*&%#@~`^$—–]|\s-\s"""
#: A token, an acronym.
TOKEN = r"[a-z0-9]+(?:_[a-z0-9]+)*(?:\.[0-9]+)?"
ACRONYM = r"^[A-Z][A-Z0-9]{1,5}$"
#: Endings of adjectives and participles, and nouns that end so.
ADJECTIVE_HEAD = r"\w(ed|ing|able|ible|ive|ous|ic|al|ly|ized|ised)$"
ADJECTIVE_NOUNS = frozenset("optics photonics electronics spintronics ceramics plastics dynamics mechanics physics thermal material materials metal metals crystal crystals signal signals".split())

#: Words that no merge key holds: modifiers, participles, function words.
GENERIC_MODIFIERS = frozenset(
    """ai ai-driven ai-powered ai-based ai-enabled advanced emerging modern novel innovative intelligent smart future
    next-generation effective robust efficient scalable digital new improved enhanced enhancing comprehensive generic various
    several strategic""".split()
)
PARTICIPLE_MODIFIERS = frozenset("driven powered based enabled aware ready centric oriented assisted augmented native".split())
FUNCTION_WORDS = frozenset("of for in on with the a an and to by from at as".split())

#: Legal forms of companies.
LEGAL_FORMS = r"\b(inc|incorporated|llc|l\.l\.c|corp|corporation|co|company|ltd|limited|plc|pbc|lp|holdings)\b\.?"

#: Parameters of tracking in URLs, hosts that only redirect, multi-label public suffixes, hosts of code,
#: words that a normalised title leaves out.
TRACKING = r"^(utm_|fbclid|gclid|yclid|ref|ref_src|oc$)"
REDIRECTS = ("news.google.com", "news.url.google.com")
SUFFIXES = ("co.uk", "com.br", "com.au", "co.jp", "com.cn", "org.uk", "ac.uk", "gov.uk", "com.tr")
CODE_HOSTS = ("github.com", "gitlab.com", "bitbucket.org", "codeberg.org", "gitflic.ru", "gitverse.ru")
TITLE_STOP = frozenset("the a an of for and in on to with new says report".split())
