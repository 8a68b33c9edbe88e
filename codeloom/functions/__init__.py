"""codeloom.functions"""
