"""codeloom.sources"""
