"""quillmill.plans"""
