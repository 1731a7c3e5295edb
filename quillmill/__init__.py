"""quillmill: literature mining and knowledge graphs on Spark DataFrames."""
