"""Word lists, patterns and limits that decide results, stated as they are."""

# --- fixed values: whitespace, words, sentences -------------------------------------------
SPACE = r"[ \t\n\r\f]+"
WORD = r"[\p{L}\p{M}\p{N}_]+"
LETTER_WORD = r"^\p{L}[\p{L}\p{M}\p{N}]+$"
SENTENCE_END = r"([.!?])[ \t\n\r\f]+"
FILLER = r"(?i)\b(um+|uh+|hmm+|like|you know|i mean)\b"
OPENER = (r"(?i)^(?:so|okay|ok|right|well|now|basically|essentially|actually|you know|i think|"
          r"i believe|i guess|i suppose|in summary|in conclusion|to summarize|to conclude|"
          r"moving on|as discussed|as we discussed|as mentioned)[, \t\n\r\f]+")

# --- fixed values: stop words -------------------------------------------------------------
# English function words; a parameter wherever it is used.
FUNCTION_WORDS = (
    "a about after again against all also am an and any are as at be because been before being "
    "between both but by can cannot could did do does doing down during each few for from "
    "further had has have having he her here hers him his how i if in into is it its itself me "
    "more most must my no nor not now of off on once only or other our ours out over own per "
    "same she should so some such than that the their theirs them then there these they this "
    "those through to too under until up upon us very via was we were what when where whether "
    "which while who whom whose why will with within without would you your yours").split()
TOPIC_EXTRA = (
    "yeah yes okay ok right meeting meetings let lets um uh actually basically really just like "
    "know think thanks thank hello hi going got things thing today everyone people said say sure "
    "well gonna want need look bit sort kind").split()
LABEL_EXTRA = (
    "yeah yes okay ok right meeting meetings let lets um uh actually basically really just like "
    "know think thanks thank hello hi going got things thing today everyone people said say sure "
    "well gonna want need look bit sort kind sorry worries works fair sounds great perfect good "
    "deal understood talk load stress totally exactly connect push haven ask hold ahead boring "
    "bye hey promise urgent honestly thought way").split()
TOPIC_STOP = sorted(set(FUNCTION_WORDS) | set(TOPIC_EXTRA))
LABEL_STOP = sorted(set(LABEL_EXTRA))

# --- fixed values: lemma dictionary (token -> lemma), a default for the P6 parameter --------
LEMMAS = {
    "agreed": "agree", "decided": "decide", "deployed": "deploy", "documents": "document",
    "handles": "handle", "launches": "launch", "minutes": "minute", "owns": "own",
    "reports": "report", "requests": "request", "reviewed": "review", "sent": "send",
    "shared": "share", "slides": "slide", "tickets": "ticket", "updated": "update",
    "urgently": "urgent", "waiting": "wait", "working": "work", "blocked": "block"}

# --- fixed values: terms compared between records ------------------------------------------
TERM_ALIASES = {"resolve": "fix", "repair": "fix", "bug": "issue", "create": "prepare",
                "draft": "prepare", "complete": "finish", "verify": "check"}
TERM_DROP = ["the", "a", "an", "to", "should", "will"]
SAME_EVENT_JACCARD = 0.72
SAME_SOURCE_JACCARD = 0.5

# --- fixed values: commitments ---------------------------------------------------------------
ACTION_HEDGE = (r"(?i)\b(if|unless|might|maybe|perhaps|would|should|could|not|never|won't|can't|"
                r"cannot)\b|n't\b")
TASK_VERB = (r"(?:send|prepare|review|deliver|update|finish|complete|handle|write|create|fix|test|"
             r"deploy|schedule|share|investigate|follow up|contact|check|publish|draft|submit|"
             r"arrange|implement|provide)")
MODAL = r"(?:will|shall|must|needs? to|have to|has to|going to)"
ACTION_PREFIX = r"(?i)^\s*(?:action item|todo|task)\s*:"
ACTION_REQUEST = r"(?i)\b(?:can you|please)\s+(?:please\s+)?" + TASK_VERB + r"\b"
ACTION_MATCH = (r"(?i)\b" + MODAL + r"\s+" + TASK_VERB + r"\b|\b(?:I|we|he|she|they)'ll\s+"
                + TASK_VERB + r"\b")
# Subject gate: a name or one of the listed subjects stands right before the modal.
SUBJECT_GATE = (r"\b(?:[A-Z][A-Za-z0-9_'-]*|i|we|you|he|she|they|[Tt]eam|[Ee]ngineering|qa)"
                r"(?:'ll\s+|\s+(?:(?:is|are|am)\s+)?" + MODAL + r"\s+)" + TASK_VERB + r"\b")
STATUS_RULES = [
    (r"(?i)\b(?:done|completed|finished|resolved)\b", "Completed"),
    (r"(?i)\b(?:in\s+progress|ongoing|working\s+on)\b", "In Progress"),
    (r"(?i)\b(?:blocked|on\s+hold|waiting)\b", "Blocked")]
STATUS_VALUES = {"pending": "Pending", "completed": "Completed", "done": "Completed",
                 "in progress": "In Progress", "ongoing": "In Progress", "blocked": "Blocked",
                 "on hold": "Blocked", "waiting": "Blocked"}
NULL_WORDS = ["null", "none", "unknown", "unassigned", "not specified"]
FIRST_PERSON = r"(?i)\b(?:i|we|I'll|we'll|I will|we will)\b"
NAME = r"[A-Z][\w'-]*(?:\s+[A-Z][\w'-]*)?"
OWNER = (r"\b(" + NAME + r")\s*,\s*(?:can you|please)\b|\b(" + NAME + r")\s+(?:will|shall|must|"
         r"needs? to|is responsible for|is\s+\w+ing)\b")
PRONOUNS = ["i", "we", "you", "he", "she", "it", "they", "that", "this", "who", "what", "there"]
DEADLINE = (
    r"(?i)\b(?:by|before|until|due(?:\s+(?:on|by))?|no later than)\s+"
    r"((?:the\s+)?(?:end\s+of\s+(?:the\s+)?(?:day|week|month)|EOD|COB|EOM|today|tonight|tomorrow|"
    r"next\s+(?:\w+)|this\s+(?:\w+)|[A-Za-z]+day|"
    r"[A-Za-z]+\s+\d{1,2}(?:st|nd|rd|th)?(?:\s*,?\s*\d{4})?|release|launch|sprint|milestone))\b")
PRIORITY = (r"(?i)\b(critical|urgent|high|medium|low)\s+priority\b|\b(priority|urgently|asap)\b")
PRIORITY_MAP = {"critical": "high", "urgent": "high", "urgently": "high", "asap": "high"}

# --- fixed values: decisions and questions ---------------------------------------------------
DECISION_HEDGE = (r"(?i)\b(if|unless|might|maybe|perhaps|could|should|would|hope|propose|"
                  r"suggest)\b")
DECISION_SPLIT = (r"(?is)^(.*?)(\b(?:decided|decides|agreed|approved|rejected|confirmed|resolved|"
                  r"selected|adopted|cancelled|canceled|finalized|finalised)\b|\bdecision\s*:)(.*)$")
NEGATION = (r"(?i)\b(?:not|n't|never|no|don't|doesn't|didn't|won't|wouldn't|haven't|hasn't)\b")
AFTER_ARTICLE = r"(?i)\b(?:the|a|an)\s+$"
AFTER_PASSIVE = r"(?i)\b(?:is|are|was|were|been|being)\s+$"
OPEN_ISSUE = (r"(?i)\b(?:need\s+to\s+figure\s+out|need\s+to\s+decide|still\s+open|open\s+question|"
              r"to\s+be\s+decided|TBD|to\s+be\s+confirmed|TBC|pending\s+decision|unclear)\b")
RHETORICAL = (
    r"^(?:right|okay|ok|yes|yeah)[?.!]*$|do you know what i mean|you know what i mean|"
    r"can (?:you|everyone) hear me|does that make sense|how are you|can you imagine|"
    r"are you wondering|how about showing|rabbit hole|have a lot to show|was it useful|"
    r"how do you know if")
NOT_A_SUBJECT = ["thing", "things", "time", "everyone", "anyone"]

# --- fixed values: topics, summaries, entities -----------------------------------------------
GENERIC_TOPICS = ["yeah", "okay", "meeting", "let", "s", "review", "actually", "basically"]
PHRASE_TAIL = (
    "owner team coach people participant participants case context benefit outcome thing company "
    "partnership fragment detail user users").split()
FRAGMENT_OPENER = (
    r"(?i)^(?:hello|hi everyone|good morning|thanks|thank you|can you hear|bye|if|namely|because|"
    r"and then i|feel free|that was the end|with a demo|there are hundreds|not a demo|"
    r"and this is)\b")
RISK = (r"(?i)\b(blocked|risk|delay|deadline|unresolved|limit|limits|missing|problem|issue)\b")
MALFORMED_POINT = r"(?i)\b(?:we|the)\s+the\s+way\b"
FOCUS_BOOST, OUTCOME_BOOST, RISK_BOOST, SHORT_FACTOR, MMR_WEIGHT = 0.3, 0.35, 0.2, 0.35, 0.65
TECH_WORDS = (
    "Python JavaScript TypeScript Java Go Rust SQL React FastAPI Docker Kubernetes AWS GCP Azure "
    "Supabase Firebase PostgreSQL MySQL MongoDB Redis Kafka Terraform GitHub Jira Slack Whisper "
    "spaCy BERT GPT LLM").split()
TECH_PHRASES = ["machine learning", "deep learning", "natural language processing", "rest api"]
PROJECT_WORDS = ["phase", "sprint", "version"]
ENTITY_LABELS = {
    "PERSON": "PERSON", "ORG": "ORG", "GPE": "LOCATION", "LOC": "LOCATION", "DATE": "DATE",
    "TIME": "TIME", "MONEY": "MONEY", "PERCENT": "PERCENT", "EVENT": "EVENT",
    "PRODUCT": "TECHNOLOGY", "WORK_OF_ART": "PROJECT", "TECHNOLOGY": "TECHNOLOGY",
    "PROJECT": "PROJECT"}
NEVER_NAMES = ["this", "that", "benefit", "benefits", "okay", "yeah"]
DATE_WORDS = (
    r"(?i)\d|monday|tuesday|wednesday|thursday|friday|saturday|sunday|january|february|march|"
    r"april|may|june|july|august|september|october|november|december|today|tomorrow|yesterday|"
    r"next|last|week|month|year|morning|afternoon|evening|tonight|noon")
APPOSITIVE = r",\s*(?:the\s+)?(?:\w+\s+){0,4}(?:company|university|organization)\b"
COMMON_PEOPLE = ["this", "that", "benefit", "developer", "limit", "okay", "yeah"]
GENERIC_PRODUCTS = ["navigation", "sidebar", "authentication system", "report", "wireframes",
                    "documentation", "backend team"]
ENTITY_GROUPS = {"people": "PERSON", "organizations": "ORG", "dates": "DATE",
                 "locations": "LOCATION", "products": "TECHNOLOGY"}
CLASS_LABELS = ["ACTION ITEM", "DECISION", "QUESTION", "DISCUSSION", "INFORMATION"]

# --- fixed values: intake ----------------------------------------------------------------------
MEDIA_EXTENSIONS = [".mp3", ".wav", ".m4a", ".mp4", ".mov"]
MEDIA_TYPES = {
    "audio/mpeg": ".mp3", "audio/mp3": ".mp3", "audio/wav": ".wav", "audio/x-wav": ".wav",
    "audio/wave": ".wav", "audio/x-m4a": ".m4a", "audio/mp4": ".m4a", "video/mp4": ".mp4",
    "video/quicktime": ".mov", "video/x-msvideo": ".avi", "application/octet-stream": ""}
MAX_UPLOAD_BYTES = 500 * 1024 * 1024

# --- versions of this engine's analysis, part of a manifest -----------------------------------------
ANALYSIS_VERSION = "colloquy-analysis-2"
PROMPT_VERSION = "colloquy-prompt-1"

# --- fixed values: records ----------------------------------------------------------------------
CATEGORIES = {"action_items": "task", "decisions": "decision", "questions": "question",
              "follow_ups": "task", "topics": "label"}
NOT_FOUND = "I couldn't find this in the meeting."

# --- fixed values: display text and chat ---------------------------------------------------------
DISPLAY_FIELDS = (
    "text full_text summary key_takeaway limitations task decision question answer evidence label "
    "excerpt keywords related_decisions related_actions related_questions content deadline dates "
    "locations description extractive abstractive").split()
CHAT_STOP = "what the this that are was were with about how who and for".split()
