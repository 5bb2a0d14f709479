"""Label sets and record types."""

# The label sets of the annotation tasks.
SENTIMENTS = ("positive", "neutral", "negative")
CATEGORIES = ("caste_slur", "religious", "gender", "general")
ENTITIES = ("PER", "LOC", "ORG")
LANGUAGES = ("RAJ", "HIN", "ENG", "TRL")
SPLITS = ("train", "validation", "test")
TASKS = ("sentiment", "ner", "toxicity")

SPAN = "struct<start:int,end:int,entity_type:string,text:string>"
TOKEN = "struct<token:string,label:string,confidence:double>"
RAW = "text string, source_url string, collected_at string, platform string, sentence_id string"
ANNOTATED = (
    "sentence_id string, text string, platform string, split string, sentiment string, sentiment_annotator_labels array<string>, "
    f"ner_spans array<{SPAN}>, ner_annotator_spans array<array<{SPAN}>>, toxicity_labels array<string>, toxicity_annotator_labels array<array<string>>, "
    f"token_language_labels array<{TOKEN}>, source_url string, collected_at string, annotated_at string"
)
#: A task of an annotation tool's JSON export.
EXPORT = (
    "id long, data struct<sentence_id:string,text:string,platform:string,source_url:string,collected_at:string>, "
    "annotations array<struct<result:array<struct<type:string,value:struct<choices:array<string>,labels:array<string>,start:int,end:int>>>>>"
)
