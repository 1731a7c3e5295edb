"""quillmill.sources"""
