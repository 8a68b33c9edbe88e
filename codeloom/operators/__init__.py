"""codeloom.operators"""
