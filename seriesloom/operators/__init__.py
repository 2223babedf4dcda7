"""seriesloom.operators"""
