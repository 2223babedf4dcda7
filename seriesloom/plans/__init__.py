"""seriesloom.plans"""
