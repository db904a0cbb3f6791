"""Word lists and constants of the text rules. They are fixed values: results depend on each of them."""

# Phrases that machine-written text overuses.
FILLERS = [
    "it is important to note", "it is worth noting", "it is essential to", "in conclusion", "in summary", "to summarize",
    "in other words", "furthermore", "moreover", "additionally", "overall", "ultimately", "it should be noted",
    "this is because", "as a result", "one of the", "some of the", "at the same time", "in today's", "in the modern",
    "plays a crucial role", "plays an important role", "it is crucial", "it is vital", "delve into", "explore",
    "key aspect", "key role", "first and foremost", "last but not least", "needless to say",
]

# Sentiment words.
POSITIVE = ["good", "great", "excellent", "amazing", "wonderful", "fantastic", "love", "perfect", "best", "awesome", "brilliant", "outstanding", "superb"]
NEGATIVE = ["bad", "terrible", "awful", "hate", "worst", "poor", "horrible", "ugly", "disgusting", "wrong", "dreadful", "pathetic", "useless"]

# Words that are no keywords.
STOP_WORDS = [
    "the", "and", "for", "with", "that", "this", "from", "are", "was", "has", "have", "been", "can", "will", "not", "but", "all", "one",
    "two", "may", "should", "could", "would", "also", "more", "such", "each", "other", "about", "which", "their", "these", "those",
    "into", "through", "during",
]

# Informal words and their formal counterparts.
INFORMAL = [
    ("a lot of", "numerous"), ("lots of", "many"), ("big", "significant"), ("small", "minimal"), ("get", "obtain"), ("got", "obtained"),
    ("show", "demonstrate"), ("shows", "demonstrates"), ("really", "considerably"), ("very", "highly"), ("things", "aspects"),
    ("stuff", "materials"), ("kids", "children"), ("guys", "individuals"), ("okay", "acceptable"), ("good", "effective"),
    ("bad", "ineffective"), ("pretty", "fairly"), ("kind of", "somewhat"), ("sort of", "somewhat"),
]

# Verbose phrases and their short forms.
VERBOSE = [
    ("in order to", "to"), ("due to the fact that", "because"), ("at the present time", "now"), ("in the event that", "if"),
    ("is able to", "can"), ("at this point in time", "now"), ("more or less", "approximately"),
]

# Type, pattern and message of the grammar rules.
GRAMMAR_RULES = [
    ("capitalization", r"\bi\b", "Personal pronoun \"I\" should be capitalized"),
    ("whitespace", r"\s{2,}", "Multiple consecutive spaces"),
    ("capitalization", r"[.!?]\s*[a-z]", "Sentence should start with capital letter"),
    ("punctuation", r"\s+[.,;!?]", "No space before punctuation"),
    ("grammar", r"(?i)their\s+are\b", "Did you mean \"there are\"?"),
    ("grammar", r"(?i)your\s+(?:going|doing)\b", "Did you mean \"you're\"?"),
]

# Bands of the readability score.
FLESCH_LEVELS = [
    (90, "Very Easy (5th grade)"), (80, "Easy (6th grade)"), (70, "Fairly Easy (7th grade)"), (60, "Standard (8th-9th grade)"),
    (50, "Fairly Difficult (10th-12th grade)"), (30, "Difficult (College)"), (None, "Very Difficult (College Graduate)"),
]

# Bands of the machine-writing score.
AI_LABELS = [(75, "Likely AI-generated"), (55, "Possibly AI-generated"), (40, "Uncertain — mixed signals"), (25, "Probably human-written"), (None, "Likely human-written")]
TOO_SHORT = "Too short to analyze"

# Plan, documents a month, plagiarism checks a month, bytes of storage (-1: no limit), features.
PLANS = [
    ("free", 5, 0, 100 * 1024 * 1024, ["basic_formatting", "grammar_check", "pdf_export"]),
    ("premium", -1, 10, 10 * 1024**3, ["basic_formatting", "grammar_check", "pdf_export", "all_formats", "citation_assistant", "plagiarism_check", "advanced_formatting", "docx_export", "latex_export"]),
    ("team", -1, -1, 100 * 1024**3, ["basic_formatting", "grammar_check", "pdf_export", "all_formats", "citation_assistant", "plagiarism_check", "advanced_formatting", "docx_export", "latex_export", "team_collaboration", "custom_templates", "api_access", "priority_support"]),
]

# Section types and the words that tell them, in order.
SECTION_KEYWORDS = [
    ("abstract", ["abstract", "summary", "overview"]),
    ("introduction", ["introduction", "background", "motivation", "problem statement"]),
    ("methodology", ["methodology", "methods", "approach", "procedure", "research design"]),
    ("results", ["results", "findings", "outcomes", "analysis"]),
    ("discussion", ["discussion", "implications", "significance", "limitations"]),
    ("conclusion", ["conclusion", "conclusions", "concluding remarks", "final remarks"]),
    ("references", ["references", "bibliography", "cited works", "works cited"]),
    ("acknowledgements", ["acknowledgements", "acknowledgments", "thanks"]),
]

# Header words of each section type.
SECTION_HEADERS = [
    ("abstract", "abstract|summary|overview"),
    ("introduction", "introduction|background|motivation|problem statement|aims and objectives"),
    ("methodology", "methodology|methods?|approach|procedure|research design|data collection|experimental setup"),
    ("results", "results?|findings?|outcomes?|experimental results"),
    ("discussion", "discussion|analysis|interpretation|implications|limitations"),
    ("conclusion", "conclusions?|concluding remarks?|summary and conclusions?|final remarks?"),
    ("references", "references?|bibliography|cited works|works cited|references cited"),
]

# Sections that a paper has to have, should have, and needs for a journal.
ESSENTIAL = ["abstract", "introduction", "conclusion"]
RECOMMENDED = ["methodology", "results", "discussion"]
JOURNAL = ["introduction", "methodology", "results", "discussion", "references"]

# What the sections of a paper should say.
KNOWLEDGE = [
    ("abstract", "The abstract provides a concise summary of the entire paper including the research problem, methodology, key findings, and conclusions in 150–250 words."),
    ("abstract", "A well-written abstract states the purpose of the study, the approach taken, the principal results, and major conclusions without references or undefined acronyms."),
    ("introduction", "The introduction establishes the research context, identifies the gap in existing literature, states the research questions or hypotheses, and outlines the paper structure."),
    ("introduction", "The introduction motivates the study by explaining the significance of the problem, providing background information, and clearly stating the aims and objectives."),
    ("literature", "The literature review critically analyses existing research related to the topic, identifies research gaps, and justifies the need for the current study."),
    ("literature", "A literature review synthesises prior work by grouping related studies thematically and highlighting agreements, contradictions, and unanswered questions."),
    ("methodology", "The methodology section describes the research design, data collection procedures, sample selection, instruments used, and data analysis techniques in sufficient detail to allow replication."),
    ("methodology", "The methodology justifies the chosen research approach, explains the experimental or analytical framework, and addresses potential limitations or biases."),
    ("results", "The results section presents the empirical findings objectively, using tables, figures, and statistical analysis without interpretation or discussion."),
    ("results", "Results are reported clearly with appropriate statistical measures such as means, standard deviations, p-values, and confidence intervals where applicable."),
    ("discussion", "The discussion interprets the results in light of the research questions and existing literature, explains unexpected findings, and acknowledges limitations."),
    ("discussion", "The discussion situates the findings within the broader field, discusses theoretical and practical implications, and suggests directions for future research."),
    ("conclusion", "The conclusion succinctly summarises the main findings, restates their significance, and highlights contributions to the field without introducing new results."),
    ("conclusion", "The conclusion addresses whether the research objectives were met, discusses limitations of the study, and proposes avenues for future work."),
    ("references", "The references list all sources cited in the paper, formatted consistently according to the chosen citation style such as APA, MLA, IEEE, Chicago, or Harvard."),
    ("references", "Every reference entry includes complete bibliographic information: authors, year, title, journal or publisher, volume, issue, and page numbers or DOI."),
    ("acknowledgements", "The acknowledgements section credits funding sources, institutional support, and individuals who contributed to the research but are not listed as authors."),
]
# Sections that the gap report asks for, and words that tell them where no vectors are at hand.
REQUIRED_SECTIONS = ["abstract", "conclusion", "discussion", "introduction", "methodology", "references", "results"]
OPTIONAL_SECTIONS = ["acknowledgements", "literature"]
SECTION_SIGNS = [
    ("abstract", ["abstract", "summary"]), ("introduction", ["introduction", "background"]), ("methodology", ["methodology", "method", "approach"]), ("results", ["results", "findings"]),
    ("discussion", ["discussion", "analysis"]), ("conclusion", ["conclusion"]), ("references", ["references", "bibliography"]),
]
