"""Fixed schemas and vocabularies of the literature engine."""

from __future__ import annotations

# They must be these for right results.
PAPER_FIELDS = [
    "paper_id", "arxiv_id", "venue_or_source", "title", "authors", "year", "abstract", "task", "method_name", "contributions", "research_problem", "motivation",
    "methodology", "datasets", "baselines", "metrics", "main_results", "limitations", "future_work", "citation_context", "related_papers", "keywords", "confidence",
]
LIST_FIELDS = ["authors", "contributions", "datasets", "baselines", "metrics", "related_papers", "keywords"]
CONFIDENCE_FIELDS = ["datasets", "baselines", "metrics", "methodology"]
SCORED_FIELDS = ["title", "research_problem", "methodology", "datasets", "baselines", "metrics", "main_results", "limitations", "keywords"]
CLEANER_HEADINGS = ["abstract", "introduction", "background", "related work", "method", "methods", "methodology", "approach", "experiments", "experimental setup", "results", "discussion", "limitations", "conclusion", "references", "appendix"]
SECTION_ALIASES = {
    "Abstract": ["abstract"],
    "Introduction": ["introduction", "intro"],
    "Related Work": ["related work", "background", "prior work"],
    "Method": ["method", "methods", "methodology", "approach", "model", "proposed method"],
    "Experiments": ["experiments", "experimental setup", "evaluation", "results"],
    "Limitations": ["limitations", "limitation", "discussion"],
    "Conclusion": ["conclusion", "conclusions", "future work"],
}
STOP_SECTIONS = ["references", "bibliography", "appendix", "acknowledgements", "acknowledgments"]
DEFAULT_ALIASES = {
    "gpt4": "GPT-4",
    "gpt 4": "GPT-4",
    "gpt-4 model": "GPT-4",
    "imagenet1k": "ImageNet",
    "image net": "ImageNet",
    "cifar10": "CIFAR-10",
    "cifar 10": "CIFAR-10",
    "f1 score": "F1",
    "f1-score": "F1",
    "accuracy score": "Accuracy",
}
KNOWN_DATASETS = ["Cora", "Citeseer", "PubMed", "CIFAR-10", "CIFAR-100", "ImageNet", "MNIST", "COCO", "SQuAD", "MMLU", "GSM8K"]
KNOWN_BASELINES = ["GCN", "GraphSAGE", "GAT", "BERT", "ResNet", "LSTM"]
KNOWN_METRICS = ["Accuracy", "F1", "Precision", "Recall", "BLEU", "ROUGE", "AUC"]
NODE_COLORS = {"Paper": "#4C78A8", "Dataset": "#F58518", "Method": "#54A24B", "Baseline": "#E45756", "Metric": "#72B7B2", "Keyword": "#B279A2"}
#: Field of a paper -> (node type, relation), in the order in which a paper's edges are made.
RELATIONS = {"method": ("Method", "proposes"), "datasets": ("Dataset", "uses"), "baselines": ("Baseline", "compares_with"), "metrics": ("Metric", "evaluated_by"), "keywords": ("Keyword", "related_to")}
FUZZY_RATIO = 0.94

TEXT_FIELDS = [f for f in PAPER_FIELDS if f not in LIST_FIELDS and f != "confidence"]
PAPER = "struct<" + ",".join(f"{f}:" + ("array<string>" if f in LIST_FIELDS else "struct<" + ",".join(f"{c}:double" for c in CONFIDENCE_FIELDS) + ">" if f == "confidence" else "string") for f in PAPER_FIELDS) + ">"
